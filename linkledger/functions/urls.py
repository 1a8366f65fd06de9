"""URL functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Query parameters that tell pages apart.
KEPT_PARAMETERS = ["baseClass", "cmd", "cmdClass", "cmdNode", "crs_next_sess", "node_id", "ref_id", "target"]
#: Patterns of addresses.
ENTRY = r"(?i)/RepositoryEntry/(\d+)"
NODE = r"(?i)/coursenode/(\d+)(/[^?#]*)?"
#: Fixed value: where a group keeps its files.
GROUP_FOLDER = "/menu/MENU_FOLDER"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def host(url: Column) -> Column:
    """The host in lower case, without user and port; empty for relative references."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), r":\d*$", ""))


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved."""
    steps = F.split(path, "/", -1)
    last = F.element_at(steps, -1)

    def step(done: Column, s: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(s == ".", done).when(s == "..", up).otherwise(F.concat(done, F.array(s)))

    done = F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.array(F.lit("")), step)
    return F.when(~path.startswith("/"), path).otherwise(F.concat(F.array_join(done, "/"), F.when(last.isin(".", ".."), "/").otherwise("")))


def resolve(base: Column, reference: Column) -> Column:
    """The address that a reference on the page `base` means."""
    return T.bind(reference, lambda r: T.bind(base, lambda b: _resolved(b, r)))


def _resolved(base: Column, reference: Column) -> Column:
    absolute, network, path, query = part(reference, 1) != "", reference.startswith("//"), part(reference, 3), reference.rlike(r"^[^#]*\?")
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    merged = F.when((part(base, 2) != "") & (part(base, 3) == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    to_path = F.when(path == "", part(base, 3)).when(path.startswith("/"), without_dots(path)).otherwise(without_dots(merged))
    to_query = F.when(query, F.concat(F.lit("?"), part(reference, 4))).when((path == "") & base.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), part(base, 4))).otherwise("")
    fragment = F.when(reference.rlike("#"), F.concat(F.lit("#"), part(reference, 5))).otherwise("")
    scheme = F.when(part(base, 1) != "", F.concat(part(base, 1), F.lit(":"))).otherwise("")
    site = F.when(base.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"), F.concat(F.lit("//"), part(base, 2))).otherwise("")
    return F.when(absolute, reference).when(network, F.concat(scheme, reference)).otherwise(F.concat(scheme, site, to_path, to_query, fragment))


def same_host(url: Column, base: Column) -> Column:
    """Whether both name one host; a reference without host counts as being on it."""
    a, b = host(url), host(base)
    return (a == "") | (b == "") | (a == b)


def entry_id(url: Column) -> Column:
    """The number of the repository entry in an address, or an empty text."""
    return F.regexp_extract(url, ENTRY, 1)


def parameters(url: Column) -> Column:
    """array<struct<name, value>> of the query, as they are written there."""
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("name"), F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("value")))


def parameter(url: Column, name: str) -> Column:
    """The first value of a parameter, decoded, or an empty text."""
    found = F.filter(parameters(url), lambda p: p["name"] == name)
    raw = F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))
    return F.coalesce(F.try_url_decode(raw), raw)


def crawl_form(url: Column) -> Column:
    """An address without fragment and with only the parameters that tell pages apart, sorted by name."""
    kept = F.filter(parameters(url), lambda p: p["name"].isin(KEPT_PARAMETERS))
    ordered = F.array_sort(kept, lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    decoded = lambda v: F.coalesce(F.try_url_decode(v), v)
    query = F.array_join(F.transform(ordered, lambda p: F.concat(p["name"], F.lit("="), F.url_encode(decoded(p["value"])))), "&")
    front = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(query == "", front).otherwise(F.concat(front, F.lit("?"), query))


def section_key(url: Column, entry: Column) -> Column:
    """What makes two addresses one section of a repository entry."""
    trimmed = T.strip(url)
    tail = F.regexp_replace(T.strip(F.regexp_extract(trimmed, NODE, 2)), "^/+|/+$", "")
    decoded = F.lower(T.strip(F.coalesce(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), tail)))
    repo = F.when(F.coalesce(entry, F.lit("")) != "", F.concat(F.lit("repo|"), entry, F.lit("|"))).otherwise("")
    node = F.concat(repo, F.lit("coursenode|"), F.regexp_extract(trimmed, NODE, 1), F.when(decoded != "", F.concat(F.lit("|path|"), decoded)).otherwise(""))
    target, own = F.lower(T.strip(parameter(url, "target"))), entry_id(url)
    node_id, cmd_node, cmd = T.strip(parameter(url, "node_id")), T.strip(parameter(url, "cmdNode")), F.lower(T.strip(parameter(url, "cmd")))
    other = (
        F.when(repo == "", crawl_form(url))
        .when((own != "") & (own != entry), F.concat(F.lit("foreign-repo|"), own))
        .when(target.rlike("^(fold|grp|crs)_"), F.concat(repo, F.lit("target|"), target))
        .when(node_id != "", F.concat(repo, F.lit("node|"), node_id))
        .when(cmd_node != "", F.concat(repo, F.lit("cmdnode|"), cmd_node))
        .when(cmd.isin("", "view"), F.concat(repo, F.lit("root")))
        .otherwise(F.concat(repo, F.lit("cmd|"), cmd))
    )
    return F.when(F.regexp_extract(trimmed, NODE, 1) != "", node).otherwise(other)


def link_target(href: Column, onclick: Column, data_href: Column, data_url: Column) -> Column:
    """Where a link leads: an attribute that names a place, or else what its script opens; an empty text if neither."""
    usable = lambda x: F.when(~F.lower(T.strip(x)).rlike("^(#?$|javascript:)"), T.strip(x))
    script = lambda pattern: F.nullif(F.regexp_extract(onclick, pattern, 1), F.lit(""))
    called = script(r"""(?:location\.href|window\.open)\s*\(\s*['"]([^'"]+)['"]""")
    assigned = script(r"""location\.href\s*=\s*['"]([^'"]+)['"]""")
    return F.coalesce(usable(href), usable(data_href), usable(data_url), called, assigned, script(r"""(/[^'"]*goto\.php[^'"]*)"""), F.lit(""))


def without_query(url: Column) -> Column:
    """An address up to its query or fragment, which become ?..."""
    return F.regexp_replace(url, r"[?#].*$", "?...")


def group_folder(url: Column) -> Column:
    """The address of a group's folder."""
    return F.concat(F.regexp_replace(T.strip(url), "/+$", ""), F.lit(GROUP_FOLDER))


def path_of(url: Column) -> Column:
    """The path of an absolute address, other references as they are."""
    return F.when(host(url) != "", part(url, 3)).otherwise(url)


def host_port(url: Column) -> Column:
    """host:port, the port by the scheme where none is named."""
    named = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    return F.concat(host(url), F.lit(":"), F.when(named != "", named).when(F.lower(part(url, 1)) == "http", "80").otherwise("443"))


def document_name(url: Column) -> Column:
    """The last part of an address's path, decoded; a plus stays."""
    last = F.substring_index(F.regexp_replace(part(url, 3), "/+$", ""), "/", -1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
