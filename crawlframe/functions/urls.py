"""URL columns: parts, resolution, normalisation and the link strategies. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
#: Suffixes with two labels under which names are registered; elsewhere the last label is the suffix.
SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "co.in", "com.br", "co.za", "com.cn", "github.io"]
#: Kept as they are in a path; the rest is percent-encoded.
SAFE = r"[A-Za-z0-9\-._~!$&'()*+,;=:@%/\[\]|\\]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, so that expressions stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-case host without user info and port."""
    return F.lower(F.regexp_extract(authority(url), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def explicit_port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":([0-9]+)$", 1)


def port(url: Column) -> Column:
    """Explicit port, or the scheme's own; null where neither is known."""
    known = F.create_map(*[F.lit(x) for pair in DEFAULT_PORTS.items() for x in pair])
    return F.coalesce(F.nullif(explicit_port(url), F.lit("")), F.try_element_at(known, scheme(url))).cast("int")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query_parameter(url: Column, name: str) -> Column:
    """First value of a query parameter, not percent-decoded; null without it."""
    return F.nullif(F.regexp_extract(F.concat(F.lit("&"), F.regexp_extract(url, r"\?([^#]*)", 1)), f"&(\\Q{name}\\E=[^&]*)", 1), F.lit("")).substr(F.lit(len(name) + 2), F.lit(1 << 30))


def percent_decode(text: Column) -> Column:
    """text with its `%XX` decoded; what isn't one stays, and bytes that aren't UTF-8 become the replacement character."""
    parts = F.regexp_extract_all(text, F.lit(r"((?:%[0-9A-Fa-f]{2})+|[^%]+|%)"), 1)
    coded = lambda x: F.when(x.rlike("^%.."), F.unhex(F.replace(x, F.lit("%"), F.lit("")))).otherwise(x.cast("binary"))
    data = F.aggregate(parts, F.lit("").cast("binary"), lambda a, x: F.concat(a, coded(x)))
    return F.make_valid_utf8(data.cast("string"))


def path_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([^./]*)$", 1))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def remove_dots(p: Column) -> Column:
    """Path with `.` and `..` segments resolved."""
    start = F.array().cast("array<string>")
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)

    def fold(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.array_append(done, part))

    joined = F.array_join(F.aggregate(parts, start, fold), "/")
    joined = F.when(last.isin(".", ".."), F.concat(F.rtrim(joined, F.lit("/")), F.lit("/"))).otherwise(joined)
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), joined).otherwise(p)


def encode_path(p: Column) -> Column:
    """Path with characters outside SAFE percent-encoded as UTF-8."""
    safe = f"^{SAFE}*$"
    each = F.transform(F.split(p, ""), lambda c: F.when(c.rlike(safe), c).otherwise(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))))
    return F.when(p.rlike(safe), p).otherwise(F.array_join(each, ""))


def normalise(url: Column) -> Column:
    """Lower-case scheme and host, no default port, path resolved and encoded, at least `/`. Null for other than http(s)."""

    def whole(u: Column) -> Column:
        parts = F.named_struct(
            F.lit("s"), scheme(u), F.lit("h"), host(u), F.lit("port"), explicit_port(u), F.lit("p"), path(u), F.lit("user"), F.regexp_extract(authority(u), r"^([^@]*@)", 1), F.lit("rest"), F.regexp_extract(u, r"^[^?#]*([?#].*)$", 1)
        )
        return let(parts, joined)

    def joined(x: Column) -> Column:
        known = F.when(x["s"] == "http", "80").when(x["s"] == "https", "443")
        p = let(let(F.when(x["p"] == "", "/").otherwise(x["p"]), remove_dots), encode_path)
        shown = F.when((x["port"] == "") | (x["port"] == known), "").otherwise(F.concat(F.lit(":"), x["port"]))
        return F.when(x["s"].isin("http", "https") & (x["h"] != ""), F.concat(x["s"], F.lit("://"), x["user"], x["h"], shown, p, x["rest"]))

    return let(url, whole)


def resolve(raw: Column, base: Column) -> Column:
    """raw against base, normalised. Null if it can't be a http(s) url: a first segment with a colon that is no url, or a base that is none."""

    def joined(x: Column) -> Column:
        href, whole = x["href"], x["base"]
        root = F.concat(scheme(whole), F.lit("://"), authority(whole))
        folder = F.regexp_extract(F.when(path(whole) == "", "/").otherwise(path(whole)), r"^(.*/)", 1)
        return (
            F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(F.regexp_extract(href, r"^([^/?#]*)", 1).contains(":"), F.lit(None))
            .when(href == "", whole)
            .when(href.startswith("//"), F.concat(scheme(whole), F.lit(":"), href))
            .when(href.startswith("/"), F.concat(root, href))
            .when(href.startswith("#"), F.concat(whole, href))
            .when(href.startswith("?"), F.concat(F.regexp_replace(whole, r"\?.*$", ""), href))
            .otherwise(F.concat(root, folder, href))
        )

    return normalise(let(F.named_struct(F.lit("href"), F.btrim(raw), F.lit("base"), without_fragment(base)), joined))


def is_address(h: Column) -> Column:
    return h.rlike(r"^[0-9.]+$") | h.startswith("[")


def registrable_domain(h: Column) -> Column:
    """The name registered under a public suffix, by a short list of suffixes; null for addresses and suffixes themselves."""
    two = h.rlike("(^|\\.)(" + "|".join(s.replace(".", "\\.") for s in SUFFIXES) + ")$")
    found = F.when(two, F.regexp_extract(h, r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1))
    return F.when(is_address(h), F.lit(None)).otherwise(F.nullif(found, F.lit("")))


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & port(a).eqNullSafe(port(b))


def same_domain(a: Column, b: Column) -> Column:
    hosts = F.named_struct(F.lit("a"), host(a), F.lit("b"), host(b))
    return let(hosts, lambda h: F.coalesce(let(registrable_domain(h["a"]), lambda x: x == registrable_domain(h["b"])), h["a"] == h["b"]))


def strategy_allows(strategy: str, url: Column, parent: Column) -> Column:
    """Whether a link from parent to url is followed. Only http(s) links ever are."""
    rules = {
        "all": F.lit(True),
        "same-hostname": host(url) == host(parent),
        "same-domain": same_domain(url, parent),
        "same-origin": same_origin(url, parent),
    }
    if strategy not in rules:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(rules)}")
    return F.coalesce(scheme(url).isin("http", "https") & rules[strategy], F.lit(False))
