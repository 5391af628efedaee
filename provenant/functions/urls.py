"""URLs as Column functions: canonical form, parts, exclusion reasons, identifiers.

All stay inside Catalyst. A null URL gives null, and so does a part that it lacks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generic syntax of RFC 3986, appendix B, with a required scheme and authority.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"
#: Control sequences (ECMA-48): introducer, parameter and intermediate bytes and a final byte; strings up to a bell or terminator, and never past the next escape; and other pairs.
ANSI = "\x1b(?:\\[[\x30-\x3f]*[\x20-\x2f]*[\x40-\x7e]|\\][^\x07\x1b]*(?:\x07|\x1b\\\\)|[\x40-\x5a\\x5c-\\x5f])"


@dataclass(frozen=True)
class Rules:
    """What is not a source. The lists are fixed values and can be replaced."""

    trackers: tuple[str, ...] = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_reader", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src")
    exact_hosts: tuple[str, ...] = ("localhost", "127.0.0.1", "0.0.0.0")
    infra_hosts: tuple[str, ...] = ("fonts.googleapis.com", "fonts.gstatic.com", "cloudflare-dns.com", "mozilla.cloudflare-dns.com", "dns.google", "static.cloudflareinsights.com")
    private_suffix: str = ".ts.net"
    reserved_tlds: tuple[str, ...] = ("test", "example", "invalid", "localhost", "local", "onion", "alt", "arpa", "internal")
    reserved_domains: tuple[str, ...] = ("example.com", "example.net", "example.org")
    assets: tuple[str, ...] = (".css", ".js", ".mjs", ".woff", ".woff2", ".ttf", ".eot", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".map")
    page_words: tuple[str, ...] = ("wiki", "blob", "tree", "releases", "actions")
    doi_hosts: tuple[str, ...] = ("doi.org", "dx.doi.org", "www.doi.org")


DEFAULT = Rules()


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it; the generated code stays small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)" + ANSI, "")


def host(url: Column) -> Column:
    """The lower-case host without user and port; an IPv6 literal keeps its brackets."""
    at = F.regexp_replace(_part(url, 2), r"^.*@", "")
    return F.nullif(F.lower(F.regexp_replace(at, r":\d*$", "")), F.lit(""))


def path(url: Column) -> Column:
    return _part(url, 3)


def site(url: Column) -> Column:
    return F.array_join(F.slice(F.split(host(url), r"\."), F.greatest(-F.size(F.split(host(url), r"\.")), F.lit(-2)), F.lit(2)), ".")


def canonical(url: Column, rules: Rules = DEFAULT) -> Column:
    """Lower-case scheme and host, no port 0, fragment, tracking fields or closing slashes; all else byte for byte. What is no URL stays as it is."""
    return _let(F.trim(url), lambda u: _canonical(u, rules))


def _canonical(url: Column, rules: Rules) -> Column:
    authority = _part(url, 2)
    user = F.regexp_extract(authority, r"^(.*@)", 1)
    port = F.regexp_extract(authority, r"(:\d+)$", 1)
    fields = F.filter(F.split(F.substring(_part(url, 4), F.lit(2), F.length(url)), "&"), lambda f: ~F.lower(F.coalesce(F.try_url_decode(F.substring_index(f, "=", 1)), F.substring_index(f, "=", 1))).isin(*rules.trackers))
    query = F.array_join(fields, "&")
    made = F.concat(F.lower(_part(url, 1)), F.lit("://"), user, F.coalesce(host(url), F.lit("")), F.when(port.rlike(r"^:0+$"), "").otherwise(port), F.regexp_replace(path(url), "/+$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(PARTS), made).otherwise(url)


def parent(url: Column) -> Column:
    """One path level up; null for at most one segment."""
    steps = F.filter(F.split(path(url), "/"), lambda s: s != "")
    up = F.concat(_part(url, 1), F.lit("://"), _part(url, 2), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), "/"))
    return F.when(F.size(steps) > 1, up)


def _number(part: Column) -> Column:
    """A number as resolvers read it: 0x hexadecimal, 0 octal, else decimal; null for anything else."""
    digits = F.regexp_replace(part, "^(0[xX]|0(?=.))", "")
    base = lambda b, ok: F.when(digits.rlike(ok), F.conv(digits, b, 10).cast("long"))
    return F.when(F.length(part) > 20, None).when(part.rlike("^0[xX]"), base(16, "^[0-9a-fA-F]+$")).when(part.rlike("^0."), base(8, "^[0-7]+$")).otherwise(base(10, "^[0-9]+$"))


def ipv4(name: Column) -> Column:
    """A host as the number that resolvers make of one to four numbers, the last of which fills all bytes left; null for anything else."""

    def whole(p: Column) -> Column:
        n = F.size(p)
        last = F.element_at(p, -1)
        head = F.aggregate(F.slice(p, F.lit(1), n - 1), F.lit(0).cast("long"), lambda total, x: total * 256 + x)
        room = F.element_at(F.array(*(F.lit(256**k).cast("long") for k in (4, 3, 2, 1))), n)
        return F.when(F.forall(F.slice(p, F.lit(1), n - 1), lambda x: x.between(0, 255)) & last.between(0, room - 1), head * room + last)

    return F.when(name.rlike(r"^[0-9][0-9a-fA-FxX]*(\.[0-9][0-9a-fA-FxX]*){0,3}$"), _let(F.transform(F.split(name, r"\."), _number), whole))


def unsafe_ipv4(number: Column) -> Column:
    """Loopback, private, carrier, link-local, documentation, benchmark, protocol, multicast, reserved or unspecified."""
    # First address and prefix length of each range of the special-purpose registry.
    ranges = (
        (0x00000000, 8), (0x0A000000, 8), (0x64400000, 10), (0x7F000000, 8), (0xA9FE0000, 16), (0xAC100000, 12), (0xC0000000, 24),
        (0xC0000200, 24), (0xC0A80000, 16), (0xC6120000, 15), (0xC6336400, 24), (0xCB007100, 24), (0xE0000000, 3),
    )
    found = F.lit(False)
    for first, bits in ranges:
        found = found | number.between(first, first + (1 << (32 - bits)) - 1)
    return found & ~number.isin(0xC0000009, 0xC000000A)


def ipv6(name: Column) -> Column:
    """The eight groups of a bracketed literal, without its zone; null for anything else."""
    bare = F.regexp_replace(F.regexp_extract(name, r"^\[([0-9a-fA-F:.]+)(?:%[^\]]*)?\]$", 1), r"(\d+)\.(\d+)\.(\d+)\.(\d+)$", "<$1.$2.$3.$4")
    tail = ipv4(F.regexp_extract(bare, "<(.*)$", 1))
    plain = F.when(bare.contains("<"), F.concat(F.regexp_replace(bare, "<.*$", ""), F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail.bitwiseAND(0xFFFF))))).otherwise(bare)

    def groups(text: Column) -> Column:
        side = lambda k: F.filter(F.split(F.get(F.split(text, "::"), F.lit(k)), ":"), lambda g: g != "")
        left, right = side(0), F.coalesce(side(1), F.array().cast("array<string>"))
        gap = F.lit(8) - F.size(left) - F.size(right)
        filled = F.when(text.contains("::") & (gap > 0), F.concat(left, F.array_repeat(F.lit("0"), gap), right)).when(~text.contains("::"), left)
        good = (F.size(filled) == 8) & F.forall(filled, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")) & (F.size(F.split(text, "::")) <= 2) & ~text.contains(":::")
        return F.when(good, F.transform(filled, lambda g: F.conv(g, 16, 10).cast("long")))

    return F.when(bare != "", _let(plain, groups))


def unsafe_ipv6(groups: Column) -> Column:
    """Everything outside the global unicast block, and the special ranges inside it; a mapped IPv4 address counts as itself."""
    g = lambda k: F.get(groups, F.lit(k))
    mapped = (g(0) == 0) & (g(1) == 0) & (g(2) == 0) & (g(3) == 0) & (g(4) == 0) & (g(5) == 0xFFFF)
    special = ((g(0) == 0x2001) & (g(1) < 0x200) & ~((g(1) == 3) | (g(1).between(0x20, 0x3F)) | ((g(1) == 4) & (g(2) == 0x112)))) | ((g(0) == 0x2001) & (g(1) == 0xDB8)) | (g(0) == 0x2002)
    return F.when(mapped, unsafe_ipv4(g(6) * 65536 + g(7))).otherwise(~g(0).between(0x2000, 0x3FFF) | special)


def excluded_reason(url: Column, rules: Rules = DEFAULT) -> Column:
    """Why a URL is no source, by the first rule that holds; null for a source."""
    # Only what begins like a literal address is read as one, and once.
    address = lambda name: F.when(name.rlike(r"^[0-9\[]"), F.struct(ipv4(name).alias("four"), ipv6(name).alias("six")))
    return _let(F.struct(host(url).alias("name"), path(url).alias("path")), lambda p: _let(address(p["name"]), lambda a: _reason(p["name"], p["path"], a["four"], a["six"], rules)))


def _reason(name: Column, where: Column, number: Column, groups: Column, rules: Rules) -> Column:
    reserved = F.substring_index(name, ".", -1).isin(*rules.reserved_tlds)
    for domain in rules.reserved_domains:
        reserved = reserved | (name == domain) | name.endswith("." + domain)
    asset = F.lower(where).rlike("(" + "|".join("\\" + a for a in rules.assets) + ")$") & ~F.lower(where).rlike("/(" + "|".join(rules.page_words) + ")/")
    return (
        F.when(name.isNull(), "no_host").when(name.isin(*rules.exact_hosts), "exact_host").when(name.isin(*rules.infra_hosts), "infra_host").when(name.endswith(rules.private_suffix), "private_suffix")
        .when(reserved, "reserved_name").when(asset, "asset").when(name.isin(*rules.doi_hosts) & ~where.rlike(r"^/10\.\d{4,9}/\S+$"), "malformed_doi")
        .when(number.isNull() & groups.isNull() & ~name.contains("."), "dotless").when(number.isNull() & groups.isNull() & ~lookup_name(name), "no_name")
        .when(unsafe_ipv4(number) | unsafe_ipv6(groups), "unsafe_address")
    )


def unbalanced(url: Column) -> Column:
    """Whether a round or square bracket closes before it opens or stays open."""
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("s"), F.lit(False).alias("bad"))

    def step(at: Column, c: Column) -> Column:
        r = at["r"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        s = at["s"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(r.alias("r"), s.alias("s"), (at["bad"] | (r < 0) | (s < 0)).alias("bad"))

    return F.aggregate(F.split(url, ""), start, step, lambda at: at["bad"] | (at["r"] != 0) | (at["s"] != 0))


def vcs_requirement(url: Column) -> Column:
    return url.rlike(r"\.git@[^/]+$")


def identifier(url: Column) -> Column:
    """(scheme, id) of a DOI, arXiv, PubMed or repository address; null where there is none."""
    return _let(F.struct(host(url).alias("name"), path(url).alias("path")), lambda p: _named(p["name"], p["path"]))


def _named(name: Column, where: Column) -> Column:
    doi = F.regexp_extract(where, r"^/(10\.\d{4,9}/\S+)$", 1)
    arxiv = F.regexp_extract(where, r"^/(?:abs|pdf)/(\d{4}\.\d{4,5})", 1)
    pmid = F.regexp_extract(where, r"^/(\d+)/?$", 1)
    # A preprint's DOI ends in a date and a number, or in a number; what follows is its version and form.
    preprint = F.regexp_extract(where, r"(10\.[0-9]{4,9}/(?:[0-9]{4}(?:\.[0-9]{2}){2}\.[0-9]+|[0-9]+))", 1)
    repo = F.regexp_replace(F.regexp_extract(where, r"^/([^/]+/[^/]+)", 1), r"\.git$", "")
    pair = lambda scheme, value: F.when(value != "", F.struct(F.lit(scheme).alias("scheme"), value.alias("id")))
    return F.coalesce(F.when(name.isin(*DEFAULT.doi_hosts), pair("doi", doi)), F.when(name.isin("arxiv.org", "www.arxiv.org"), pair("arxiv", arxiv)), F.when(name == "pubmed.ncbi.nlm.nih.gov", pair("pmid", pmid)), F.when(name == "github.com", pair("repo", repo)), F.when(name.rlike(r"(^|\.)(bio|med)rxiv\.org$"), pair("doi", preprint)))


def doi_of(url: Column) -> Column:
    """The DOI that an address carries: all of a resolver's path, or the DOI inside a preprint server's; null for any other host."""
    return _let(F.struct(host(url).alias("name"), F.regexp_extract(url, r"^[^:]+://[^/]*/(.*)$", 1).alias("rest")), lambda p: _doi(p["name"], p["rest"]))


def _doi(name: Column, rest: Column) -> Column:
    """DOI syntax: "10.", a registrant of 4 to 9 digits, a slash, and a suffix without white space."""
    form = r"10\.\d{4,9}/"
    whole = F.when(name.isin(*DEFAULT.doi_hosts), F.regexp_extract(rest, f"^({form}\\S+)$", 1))
    inside = F.when(name.rlike("(bio|med)rxiv[.]org$"), F.regexp_extract(F.regexp_extract(rest, "^([^?#]*)", 1), f"({form}\\S+)", 1))
    return F.nullif(F.coalesce(whole, inside), F.lit(""))


#: First path segments of the code host that are pages of its own, never an owner.
NOT_OWNERS = ("settings", "orgs", "sponsors", "features", "about")


def repo_slug(url: Column) -> Column:
    """owner/repo of a repository's root page; null for deeper pages, other hosts and the host's own pages."""
    return _let(F.struct(host(url).alias("name"), F.regexp_extract(path(url), r"^/([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)/?$", 1).alias("found")), lambda p: _slug(p["name"], p["found"]))


def _slug(name: Column, found: Column) -> Column:
    slug = F.regexp_replace(found, r"\.git$", "")
    bad = (slug == "") | slug.endswith("/") | F.lower(F.substring_index(slug, "/", 1)).isin(*NOT_OWNERS)
    return F.when(name.isin("github.com", "www.github.com") & ~bad, slug)


def lookup_name(name: Column) -> Column:
    """Whether a resolver could look a host up: labels of 1 to 63 letters, digits and inner hyphens, at most 253 in all; other scripts pass."""
    return (F.length(name) <= 253) & F.rtrim(name).rlike(r"^(?:(?!-)[a-z0-9\u0080-\x{10FFFF}-]{1,63}(?<!-)\.)*(?!-)[a-z0-9\u0080-\x{10FFFF}-]{1,63}(?<!-)\.?$")
