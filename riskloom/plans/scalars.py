"""Scalar functions over names, catalogue names, addresses, times and JSON made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import cpe, packages, text, times, urls, versions
from riskloom.operators import identify, rank
from riskloom.session import table
from riskloom.sources import documents, registries

#: Names of many shapes, in SQL that both engines read.
NAME = """case p_partkey % 9 when 0 then '  ' || p_brand || '_' || p_name || ' (old) ' when 1 then 'Foo__Bar.-' || p_type when 2 then ' ' when 3 then '@scope/' || replace(p_name, ' ', '-')
  when 4 then 'github.com/Acme/' || p_type when 5 then 'org.acme:acme-core-' || lower(p_type) || '-api' when 6 then 'the art of ' || p_name || ' and ' || p_type || ' tools' when 7 then p_brand || ' ' || p_name end"""
VENDOR = "case when p_partkey % 2 = 0 then p_brand else 'Foo' end"
ECOSYSTEM = "case p_partkey % 4 when 0 then 'pypi' when 1 then 'crates.io' when 2 then 'maven' else 'go' end"


def trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def containment_sql(x: str) -> str:
    return trim_sql(rf"replace(replace(lower(coalesce({x}, '')), '_', ' '), '\', '')")


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[^a-z0-9]+'), lambda t: t <> '')"


def normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms, words and variants of names."""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{NAME} as n", f"{VENDOR} as v", f"{ECOSYSTEM} as e")
    n, v, e = F.col("n"), F.col("v"), F.col("e")
    joined = lambda a: F.array_join(a, ",")
    return t.select(
        "p_partkey", text.control_trim(n).alias("trimmed"), text.blank_to_null(n).alias("not_blank"), text.package_name(e, n).alias("package"), text.containment_form(n).alias("containment"), text.source_form(n).alias("source"),
        text.bundled_form(n).alias("bundled"), joined(text.tokens(text.containment_form(n))).alias("words"), text.without_annotation(n).alias("bare"), text.acronym(n).alias("acronym"), text.without_vendor(n, v).alias("vendorless"),
        joined(text.artifact_variants(n)).alias("variants"), text.last_segment(n).alias("segment"), text.escaped_module(n).alias("escaped"), text.scoped_id(F.concat(F.lit(" x"), F.col("p_partkey").cast("string")), n, F.col("p_partkey")).alias("scoped"),
        text.cut_text(n, 12).alias("cut"), n.rlike(text.SEED_NAME).alias("is_seed"),
    )


_WORDS4 = "list_filter(regexp_split_to_array(lower(n), '[^a-zA-Z0-9]+'), lambda w: w <> '' and w not in ('a','an','the','of','for','and','or','&'))"
_REST = f"substr(n, length({trim_sql('v')}) + 1)"
_HOSTLESS = rf"case when regexp_matches({trim_sql('n')}, '^[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{{2,}}/.+') then regexp_extract({trim_sql('n')}, '^[^/]*/(.*)$', 1) else n end"
_ARTIFACT = trim_sql("regexp_extract(n, '([^:]*)$', 1)")
_GENERIC = "('core','api','client','clients','impl','common','commons')"
NORMALIZERS_SQL = rf"""
with t as (select p_partkey, {NAME} as n, {VENDOR} as v, {ECOSYSTEM} as e from part)
select p_partkey, {trim_sql("n")} as trimmed, case when trim(n) <> '' then n end as not_blank,
  case e when 'pypi' then regexp_replace(lower(n), '[-_.]+', '-', 'g') when 'crates.io' then regexp_replace(lower(n), '[-_]+', '-', 'g') else lower(n) end as package,
  {containment_sql("n")} as containment, {trim_sql("replace(replace(lower(coalesce(n, '')), '_', ' '), '-', ' ')")} as source,
  regexp_replace(lower(n), '[\s_\-]', '', 'g') as bundled, array_to_string({tokens_sql(containment_sql("n"))}, ',') as words,
  case when {trim_sql("regexp_extract(n, '^([^(（※]*)', 1)")} <> '' then {trim_sql("regexp_extract(n, '^([^(（※]*)', 1)")} else {trim_sql("n")} end as bare,
  case when len({_WORDS4}) >= 4 then array_to_string(list_transform({_WORDS4}, lambda w: w[1]), '') end as acronym,
  case when v <> '' and starts_with(lower(n), lower({trim_sql("v")})) and not regexp_matches({_REST}, '^[\pL\p{{Nd}}]') and {trim_sql(f"regexp_replace({_REST}, '^[^a-zA-Z0-9]+', '')")} <> ''
    then {trim_sql(f"regexp_replace({_REST}, '^[^a-zA-Z0-9]+', '')")} end as vendorless,
  case when n is null then '' when regexp_matches({trim_sql("n")}, '^[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)+:[A-Za-z0-9_.+-]+$') then
    array_to_string(list_concat([{_ARTIFACT}], case when regexp_replace({_ARTIFACT}, '(?i)(?:-(?:core|api|client|clients|impl|common|commons))+$', '') <> {_ARTIFACT} then [regexp_replace({_ARTIFACT}, '(?i)(?:-(?:core|api|client|clients|impl|common|commons))+$', '')] else [] end,
      list_filter(string_split({_ARTIFACT}, '-'), lambda s: length(s) >= 3 and lower(s) not in {_GENERIC})), ',') else '' end as variants,
  regexp_extract(coalesce({_HOSTLESS}, ''), '([^:/]*)$', 1) as segment, lower(regexp_replace(n, '([A-Z])', '!\1', 'g')) as escaped,
  left('llm:' || coalesce(n, 'item' || p_partkey) || ':x' || p_partkey, 100) as scoped, left(n, 12) as cut, regexp_full_match(n, '[A-Za-z0-9._@/~+-]+') as is_seed
from t
"""

CPE = r"""case when p_partkey % 11 = 0 then 'cpe:2.3:a' when p_partkey % 11 = 1 then 'cpe:2.3::acme:tool' else 'cpe:2.3:' || case p_partkey % 3 when 0 then 'a' when 1 then 'o' else 'h' end || ':' || lower(replace(p_brand, '#', '_'))
  || case when p_partkey % 5 = 0 then '\:http' else '' end || ':' || replace(p_name, ' ', '_') || case when p_partkey % 7 = 0 then '\\' else '' end || ':' || p_size || '.' || (p_partkey % 10) || ':rc1:*:*:*:' || case p_partkey % 4 when 0 then 'node.js' when 1 then '*' else 'linux' end || ':*:*' end"""


def cpe_parse_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of catalogue names, escapes heeded or not, and names built anew."""
    # Spark's parser halves backslashes in literals.
    t = table(spark, sf_dir, "part").select("p_partkey", F.expr(CPE.replace("\\", "\\\\")).alias("c"))
    c = F.col("c")
    return t.select(
        "p_partkey", cpe.part(c).alias("part"), cpe.vendor(c).alias("vendor"), cpe.product(c).alias("product"), cpe.version(c).alias("version"), cpe.with_version(c, F.lit("9.9")).alias("with_version"), cpe.masked(c).alias("masked"),
        cpe.plain_part(c).alias("plain_part"), cpe.plain_segment(c, 11).alias("target_sw"), cpe.catalogue_major(c).alias("major"), cpe.build(cpe.part(c), F.coalesce(cpe.vendor(c), F.lit("x")), F.coalesce(cpe.product(c), F.lit("y")), cpe.version(c)).alias("built"),
    )


CPE_SQL = rf"""
with t as (select p_partkey, {CPE} as c from part), s as (select *, regexp_extract_all(c || ':', '((?:\\.|[^:\\])*):', 1) as g, string_split(c, ':') as p, string_split(regexp_replace(c, '\\:', '', 'g'), ':') as q from t)
select p_partkey, case when len(g) > 2 and trim(g[3]) <> '' then g[3] else 'a' end as part, case when len(g) > 4 then g[4] end as vendor, case when len(g) > 4 then g[5] end as product,
  case when len(g) > 5 then g[6] else '*' end as version,
  case when len(g) > 5 then array_to_string(list_concat(g[1:5], ['9.9'], case when len(g) > 6 then ['*'] else [] end, g[8:]), ':') else c end as with_version,
  case when len(p) > 5 then array_to_string(list_concat(p[1:5], ['*'], p[7:]), ':') else c end as masked, p[3] as plain_part, coalesce(q[11], '') as target_sw,
  nullif(regexp_extract(coalesce(q[6], ''), '^[0-9]{{1,9}}', 0), '')::int as major,
  'cpe:2.3:' || case when len(g) > 2 and trim(g[3]) <> '' then g[3] else 'a' end || ':' || case when len(g) > 4 then g[4] else 'x' end || ':' || case when len(g) > 4 then g[5] else 'y' end || ':' || case when len(g) > 5 then g[6] else '*' end || ':*:*:*:*:*:*:*' as built
from s
"""

PURL = """case p_partkey % 6 when 0 then 'pkg:npm/' || replace(p_name, ' ', '%20') || '@' || p_size || '?arch=x#sub' when 1 then 'pkg:maven/org/' || p_type || '@1%2B2+3' when 2 then 'pkg:npm/none'
  when 3 then 'npm/a@1' when 4 then 'pkg:rpm/redhat/%zz@1' else 'pkg:deb/x@' end"""


def package_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package addresses parsed and built, and what ecosystems are called elsewhere."""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PURL} as p", f"{ECOSYSTEM} as e", "'Org.x:' || p_type as n", "p_size")
    parsed = packages.parsed(F.col("p"))
    return t.select(
        "p_partkey", parsed["name"].alias("name"), parsed["version"].alias("version"), packages.address(F.col("e"), F.col("n"), F.col("p_size").cast("string")).alias("address"),
        packages.advisory_ecosystem(F.col("e")).alias("advisory"), packages.ecosystem_of_advisory(packages.advisory_ecosystem(F.col("e"))).alias("back"), packages.target_software(F.col("e")).alias("target"),
    )


PURL_SQL = rf"""
with t as (select p_partkey, {PURL} as p, {ECOSYSTEM} as e, 'Org.x:' || p_type as n, p_size from part)
select p_partkey, case p_partkey % 6 when 0 then p_raw when 1 then p_type when 4 then '%zz' end as name, case p_partkey % 6 when 0 then p_size::varchar when 1 then '1+2+3' when 4 then '1' end as version,
  'pkg:' || case e when 'go' then 'golang' when 'crates.io' then 'cargo' else e end || '/' || case e when 'maven' then replace(n, ':', '/') else n end || '@' || p_size as address,
  case e when 'pypi' then 'PyPI' when 'maven' then 'Maven' when 'go' then 'Go' else e end as advisory, e as back, case e when 'pypi' then 'python' when 'crates.io' then 'rust' when 'go' then 'go' end as target
from t join (select p_partkey, p_name as p_raw, p_type from part) using (p_partkey)
"""

URL = """case page_id % 7 when 0 then url when 1 then 'marketplace.visualstudio.com/items?itemName=x.y' || page_id when 2 then ' https://Addons.Mozilla.org/en/' when 3 then 'https://chrome.google.com/webstore/detail/x'
  when 4 then 'https://chrome.google.com/webstores' when 5 then 'ftp://plugins.jetbrains.com.evil.org/x' else 'https://beta.plugins.jetbrains.com:8443/plugin' end"""


def url_host_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths, safe addresses, and what an install address declares."""
    t = table(spark, sf_dir, "pages").selectExpr("page_id", f"{URL} as u")
    return t.select("page_id", urls.host(F.col("u")).alias("host"), urls.path(F.col("u")).alias("path"), urls.declared_target(F.col("u")).alias("target"), urls.safe(F.col("u")).alias("safe"))


URL_SQL = rf"""
with t as (select page_id, {URL} as u from pages), w as (select *, case when regexp_matches(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*://') then trim(u) else 'https://' || trim(u) end as s from t),
h as (select *, lower(regexp_extract(s, '^[^/]*//([^/:?#]*)', 1)) as host, regexp_extract(s, '^[^/]*//[^/?#]*([^?#]*)', 1) as path from w)
select page_id, host, path, case when host = 'marketplace.visualstudio.com' or ends_with(host, '.marketplace.visualstudio.com') then 'visual_studio_code' when host = 'chromewebstore.google.com' or ends_with(host, '.chromewebstore.google.com') then 'chrome'
  when host = 'plugins.jetbrains.com' or ends_with(host, '.plugins.jetbrains.com') then 'jetbrains' when host = 'addons.mozilla.org' or ends_with(host, '.addons.mozilla.org') then 'firefox'
  when (host = 'chrome.google.com' or ends_with(host, '.chrome.google.com')) and (path = '/webstore' or starts_with(path, '/webstore/')) then 'chrome' end as target,
  case when regexp_matches(trim(u), '^(?i:https?):\S+$') then u end as safe from h
"""

STAMP = """case event_id % 6 when 0 then '2024-03-05T06:07:08Z' when 1 then '2024-03-05T06:07:08.25+09:00' when 2 then '2024-03-05T06:07:08' when 3 then '2024-03-05' when 4 then 'soon' end"""


def times_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with and without an offset, HTTP dates, middles of windows, months, staleness."""
    t = table(spark, sf_dir, "events").selectExpr("event_id", "ts", f"{STAMP} as s")
    ts = F.col("ts").cast("timestamp")
    return t.select(
        "event_id", times.strict(F.col("s")).cast("timestamp_ntz").alias("strict"), times.lenient(F.col("s")).cast("timestamp_ntz").alias("lenient"), times.http_date(F.lit("Sun, 06 Nov 1994 08:49:37 GMT")).cast("timestamp_ntz").alias("http"),
        times.midpoint(ts, ts + F.expr("INTERVAL 3 DAYS")).cast("timestamp_ntz").alias("middle"), times.month_path(ts).alias("month"), times.is_stale(ts, F.expr("timestamp'2024-01-04 00:00:00'"), 2).alias("stale"),
    )


TIMES_SQL = rf"""
select event_id, case event_id % 6 when 0 then timestamp '2024-03-05 06:07:08' when 1 then timestamp '2024-03-04 21:07:08.25' end as strict,
  case event_id % 6 when 0 then timestamp '2024-03-05 06:07:08' when 1 then timestamp '2024-03-04 21:07:08.25' when 2 then timestamp '2024-03-05 06:07:08' end as lenient,
  timestamp '1994-11-06 08:49:37' as http, ts + interval 36 hours as middle, strftime(ts, '%Y/%m') as month, ts < timestamp '2024-01-02 00:00:00' as stale from events
"""

RECORD = """'{"descriptions":[{"lang":"' || case event_id % 3 when 0 then 'fr' else 'en' end || '","value":"v' || event_id || '"},{"lang":"en","value":"w"}],"aliases":["X-1","CVE-' || user_id || '",7],"versions":{"1.' || user_id || '":1,"2":{}},"score":' ||
  case event_id % 4 when 0 then 'null' else '{"v3":' || value || '}' end || '}'"""


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First English description, alias by prefix, names of fields, values by path with null for what is missing."""
    t = table(spark, sf_dir, "events").selectExpr("event_id", f"{RECORD} as j")
    d = F.from_json("j", "descriptions array<struct<lang:string,value:string>>, aliases array<string>, score struct<v3:double>")
    return t.select("event_id", "j", d.alias("d")).select(
        "event_id", documents.english(F.col("d.descriptions")).alias("description"), documents.first_alias(F.col("d.aliases"), "CVE-").alias("alias"), F.array_join(registries.versions_of_keys(F.col("j"), "versions"), ",").alias("versions"),
        F.coalesce("d.score.v3", F.lit(-1.0)).alias("score"), F.get_json_object("j", "$.missing").alias("missing"),
    )


JSON_SQL = """
select event_id, case event_id % 3 when 0 then 'w' else 'v' || event_id end as description, 'CVE-' || user_id as alias, '1.' || user_id || ',2' as versions, case event_id % 4 when 0 then -1.0 else value end::double as score, null::varchar as missing from events
"""


def range_event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of lists of events: opened, moved, closed, dropped and open-ended ones."""
    t = table(spark, sf_dir, "events").select("event_id")
    kinds = F.array(*(F.floor(F.col("event_id") / 4**i) % 4 for i in range(4)))
    event = lambda k, i: F.when(k == 0, F.create_map(F.lit("introduced"), i.cast("string"))).when(k == 1, F.create_map(F.lit("fixed"), F.concat(F.lit("f"), i.cast("string")))).when(k == 2, F.create_map(F.lit("last_affected"), F.concat(F.lit("l"), i.cast("string")))).otherwise(F.create_map(F.lit("limit"), F.lit("9")))
    r = documents.range_events(F.transform(kinds, event))
    shown = F.array_join(F.transform(r, lambda x: F.concat_ws("/", F.coalesce(x["introduced"], F.lit("-")), F.coalesce(x["fixed"], F.lit("-")), F.coalesce(x["last_affected"], F.lit("-")))), " ")
    return t.select("event_id", shown.alias("ranges"))


# The state before each event: where the last opening lies that no closing follows.
FOLD_SQL = """
with e as (select event_id, i::int as i, ((event_id // (4 ** i)::bigint) % 4)::int as k from events, unnest(range(0, 4)) as r(i)),
o as (select *, max(case when k = 0 then i else -1 end) over w as opened, max(case when k in (1, 2) then i else -1 end) over w as closed from e window w as (partition by event_id order by i rows between unbounded preceding and 1 preceding)),
c as (select event_id, i, case when opened > 0 then opened::varchar else '-' end || '/' || case k when 1 then 'f' || i else '-' end || '/' || case k when 2 then 'l' || i else '-' end as r from o where k in (1, 2) and opened > coalesce(closed, -1) and opened >= 0
  union all select event_id, 9, case when a > 0 then a::varchar else '-' end || '/-/-' from (select event_id, max(case when k = 0 then i else -1 end) as a, max(case when k in (1, 2) then i else -1 end) as b from e group by 1) where a > b)
select event_id, coalesce((select string_agg(r, ' ' order by i) from c where c.event_id = events.event_id), '') as ranges from events
"""


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plausible names, contiguous runs of words, pairs of words: each part against the fifth one after it."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"))
    q = table(spark, sf_dir, "part").select((F.col("p_partkey") - 5).alias("p_partkey"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("b"))
    a, b = text.tokens(F.col("a")), text.tokens(F.col("b"))
    return p.join(q, "p_partkey").select("p_partkey", text.plausible(F.col("a"), F.col("b")).alias("plausible"), text.run_at(b, a).cast("int").alias("place"), F.size(text.pairs(a, b)).alias("pairs"), identify.contained(F.col("a"), F.col("b")).alias("contained"))


OVERLAP_SQL = """
with t as (select p.p_partkey, lower(p.p_name) as a, lower(q.p_type || ' ' || q.p_name) as b from part p join part q on q.p_partkey = p.p_partkey + 5), w as (select *, string_split(a, ' ') as x, string_split(b, ' ') as y from t)
select p_partkey, contains(a, b) or contains(b, a) or len(list_filter(x, lambda w: length(w) >= 4 and contains(b, w))) > 0 as plausible,
  coalesce(list_filter(range(1, len(y) - len(x) + 2), lambda i: y[i:i + len(x) - 1] = x)[1], 0)::int as place, len(list_distinct(x))::int * len(list_distinct(y))::int as pairs, contains(b, a) or len(list_filter(x, lambda w: not list_contains(y, w))) = 0 as contained from w
"""


def registry_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registries asked for names of each shape."""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", f"case when p_partkey % 10 = 8 then 'acme/' || p_type when p_partkey % 10 = 9 then lower(p_type) else {NAME} end as n")
    return t.select("p_partkey", F.array_join(identify.registries(F.col("n")), ",").alias("registries"))


ROUTING_SQL = rf"""
with t as (select p_partkey, trim(case when p_partkey % 10 = 8 then 'acme/' || p_type when p_partkey % 10 = 9 then lower(p_type) else {NAME} end) as n from part)
select p_partkey, case when n is null or n = '' then '' when regexp_matches(n, '^@[^/]+/[^/]+$') then 'npm' when regexp_matches(n, '^[A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{{2,}}/.+') then 'go' when regexp_matches(n, '^/[^/\s]+$') then ''
  when regexp_matches(n, '^[^/\s.]+/[^/\s]+$') then 'packagist' when contains(n, ':') then 'maven' when regexp_matches(n, '\s') then '' else 'npm,pypi,maven,go,nuget,rubygems,crates.io,packagist,hex,pub' end as registries from t
"""


def target_sw_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidates their targets let through, with or without a declared target and a registry match."""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", "case p_partkey % 6 when 0 then array() when 1 then array('jenkins', '*') when 2 then array('node.js', 'linux') when 3 then array('node.js') when 4 then array('php', 'firefox') end as g", "case when p_size % 3 = 0 then 'firefox' when p_size % 3 = 1 then 'node.js' end as d", "p_size % 2 = 0 as r")
    return t.select("p_partkey", identify.passes_target(F.col("g").cast("array<string>"), F.col("d"), F.col("r")).alias("passes"))


GATE_SQL = """
select p_partkey, case p_partkey % 6 when 1 then false when 3 then case p_size % 3 when 0 then false when 1 then true else p_size % 2 = 0 end when 4 then case p_size % 3 when 0 then true when 1 then false else p_size % 2 = 0 end else true end as passes from part
"""


def severity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, coverage of the catalogue and the reason why research is incomplete, row by row."""
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", "case p_partkey % 6 when 0 then 'CRITICAL' when 1 then 'HIGH' when 2 then 'MEDIUM' when 3 then 'LOW' when 4 then 'none' end as s", "p_size", "p_partkey % 4 > 0 as ok", "p_partkey % 5 = 0 as cut")
    reason = identify.incomplete_reason(F.col("ok"), F.col("cut"), F.col("p_size") % 3, F.when(F.col("p_size") % 2 == 0, F.lit(0.9)), F.when(F.col("p_size") % 4 == 0, F.lit("AI_CALL_FAILED")))
    return t.select("p_partkey", rank.severity_score(F.col("s")).alias("score"), versions.coverage(F.col("p_size") % 7, F.concat(F.col("p_size").cast("string"), F.lit(".1"))).alias("coverage"), reason.alias("reason"))


SCORES_SQL = """
select p_partkey, (case p_partkey % 6 when 0 then 9.0 when 1 then 7.5 when 3 then 2.0 else 5.0 end)::double as score, case when p_size % 7 = 0 then 1 when p_size <= p_size % 7 then 0 when p_size <= 2 * (p_size % 7) then 1 else 2 end as coverage,
  case when p_size % 3 = 0 and p_partkey % 4 > 0 and p_size % 2 <> 0 then 'IDENTIFICATION_TOO_WEAK' when p_size % 3 = 0 and p_partkey % 4 > 0 and p_size % 4 = 0 then 'AI_CALL_FAILED'
    when p_partkey % 4 = 0 then 'SOURCES_FAILED' when p_partkey % 5 = 0 then 'FINDINGS_TRUNCATED' end as reason from part
"""

#: name -> (query, DuckDB SQL)
SCALARS = {
    "normalizers": (normalizers, NORMALIZERS_SQL),
    "cpe_parse_build": (cpe_parse_build, CPE_SQL),
    "package_addresses": (package_addresses, PURL_SQL),
    "url_host_match": (url_host_match, URL_SQL),
    "times_parse": (times_parse, TIMES_SQL),
    "json_extract": (json_extract, JSON_SQL),
    "range_event_fold": (range_event_fold, FOLD_SQL),
    "token_overlap": (token_overlap, OVERLAP_SQL),
    "registry_routing": (registry_routing, ROUTING_SQL),
    "target_sw_gate": (target_sw_gate, GATE_SQL),
    "severity_scores": (severity_scores, SCORES_SQL),
}
