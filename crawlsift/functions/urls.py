"""URL columns: host names, root domains and resolution of references.

``resolve`` works in stages, each a projection on short columns, so Catalyst keeps
every expression small and evaluates each intermediate value once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.functions.hosts import ascii_host
from crawlsift.functions.regex import quoted
from crawlsift.functions.stage import pin
from crawlsift.functions.text import rmatch, trim

# --- fixed values: schemes with an authority, and their default ports ---------
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
# --- fixed values: characters that are percent-encoded in each URL part -------
PATH_UNSAFE = r"""[\x00-\x20"#<>?^`{}\x7F]|[^\x00-\x7F]"""
QUERY_UNSAFE = r"""[\x00-\x20"#<>'\x7F]|[^\x00-\x7F]"""
FRAGMENT_UNSAFE = r"""[\x00-\x20"<>`\x7F]|[^\x00-\x7F]"""
# --- fixed values: characters no host name may hold ---------------------------
HOST_FORBIDDEN = r"""[\x00-\x20#/:<>?@\[\]\\^|%\x7F]"""
DOT_SEGMENT = r"""(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|\z)"""


def root_domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def same_site(host: Column, page_host: Column) -> Column:
    """Equal host, the root domain itself, or any host below the root domain."""
    root = root_domain(page_host)
    return (
        (host == page_host)
        | (host == root)
        | F.endswith(host, F.concat(F.lit("."), root))
    )


def host_of(url: Column) -> Column:
    """Lower-case host name of an absolute URL, '' when there is none."""
    auth = F.regexp_extract(
        trim(url), r"^(?i:https?|wss?|ftp):[/\\]*([^/\\?#]*)", 1
    )
    host = F.lower(F.regexp_extract(auth, r"^(?:.*@)?(\[[0-9a-fA-F:.]+\]|[^:@]*)(?::[0-9]*)?\z", 1))
    return F.when(rmatch(host, HOST_FORBIDDEN) & ~F.startswith(host, F.lit("[")), F.lit("")).otherwise(host)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(trim(url), r"(?s)#.*\z", "")


def resolve(df: DataFrame, ref: str, base: str | None, out: str) -> DataFrame:
    """Add ``{out}_href/_scheme/_host/_path/_query`` for reference ``ref``.

    ``base`` is the prefix of columns made by an earlier ``resolve`` of the base URL,
    or None when ``ref`` has to be absolute. ``{out}_href`` is null for a reference
    that a browser would reject or that has no web scheme.
    """
    p = f"__{out}_"

    def b(name):
        return f"{base}_{name}" if base else "cast(null AS string)"

    def encoded(text, unsafe):
        return (
            f"CASE WHEN rlike({text}, {quoted(unsafe)}) THEN array_join(transform(split({text}, ''), "
            f"ch -> CASE WHEN rlike(ch, {quoted(unsafe)}) THEN regexp_replace(hex(encode(ch, 'UTF-8')), '(..)', '%$1') "
            f"ELSE ch END), '') ELSE {text} END"
        )

    ports = " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in DEFAULT_PORTS.items())
    schemes = ", ".join(f"'{s}'" for s in DEFAULT_PORTS)
    up, here = r"r'(?i)^(?:\.|%2e){2}\z'", r"r'(?i)^(?:\.|%2e)\z'"
    # Later columns use earlier ones by name; Spark turns that into a chain of projections.
    steps = {
        "ref": rf"regexp_replace(regexp_replace(`{ref}`, r'^[\x00-\x20]+|[\x00-\x20]+\z', ''), r'[\t\n\r]', '')",
        "given": rf"lower(regexp_extract({p}ref, r'^([A-Za-z][A-Za-z0-9+.\-]*):', 1))",
        "rest": f"CASE WHEN {p}given = '' THEN {p}ref ELSE substring({p}ref, length({p}given) + 2) END",
        "main": rf"translate(regexp_extract({p}rest, r'^[^?#]*', 0), r'\', '/')",
        "search": rf"regexp_extract({p}rest, r'^[^?#]*(\?[^#]*)?', 1)",
        "hash": rf"regexp_extract({p}rest, r'(?s)^[^#]*(#.*)?', 1)",
        "scheme": f"CASE WHEN {p}given = '' THEN {b('scheme')} ELSE {p}given END",
        "full": f"({p}given <> '' AND NOT {p}given <=> {b('scheme')}) OR startswith({p}main, '//')",
        "auth": f"regexp_extract({p}main, r'^/*([^/]*)', 1)",
        "user": f"regexp_extract({p}auth, r'^(.*@)?', 1)",
        "raw_host": rf"CASE WHEN {p}full THEN regexp_extract({p}auth, r'^(?:.*@)?(\[[0-9a-fA-F:.]+\]|[^:@]*)(?::[0-9]*)?\z', 1) END",
        "host": f"CASE WHEN {p}full THEN {ascii_host(f'{p}raw_host')} ELSE {b('host')} END",
        "given_port": rf"regexp_replace(regexp_extract({p}auth, r':([0-9]+)\z', 1), r'^0+(?=[0-9])', '')",
        "port": f"CASE WHEN {p}given_port = CASE {p}scheme {ports} END THEN '' ELSE {p}given_port END",
        "raw_path": f"CASE WHEN {p}full THEN regexp_replace({p}main, r'^/*[^/]*', '') WHEN startswith({p}main, '/') THEN {p}main "
        f"WHEN {p}main = '' THEN {b('path')} ELSE concat(regexp_extract({b('path')}, r'^(.*/)', 1), {p}main) END",
        "ok": f"({p}given = '' OR {p}given IN ({schemes})) AND coalesce({p}host, '') <> '' "
        f"AND (startswith({p}host, '[') OR NOT rlike({p}host, {quoted(HOST_FORBIDDEN)})) "
        # Nearly every reference has no port, and a cast that fails is dear.
        f"AND length({p}port) <= 5 AND ({p}port = '' OR try_cast({p}port AS int) <= 65535)",
        "authority": f"CASE WHEN {p}full THEN concat(CASE WHEN {p}user IN ('@', ':@') THEN '' ELSE {p}user END, {p}host, "
        f"CASE WHEN {p}port = '' THEN '' ELSE concat(':', {p}port) END) ELSE {b('authority')} END",
        "path": encoded(f"{p}raw_path", PATH_UNSAFE),
        "segments": f"CASE WHEN rlike({p}path, {quoted(DOT_SEGMENT)}) THEN split({p}path, '/') END",
        "dotless": f"concat(aggregate(slice({p}segments, 2, size({p}segments)), '', (acc, seg) -> "
        rf"CASE WHEN rlike(seg, {up}) THEN regexp_replace(acc, r'/[^/]*\z', '') WHEN rlike(seg, {here}) THEN acc "
        f"ELSE concat(acc, '/', seg) END), "
        f"CASE WHEN rlike(element_at({p}segments, -1), {up}) OR rlike(element_at({p}segments, -1), {here}) THEN '/' ELSE '' END)",
        "clean_path": f"CASE WHEN {p}path = '' THEN '/' WHEN {p}segments IS NULL THEN {p}path ELSE {p}dotless END",
        "query": f"substring({p}search, 2)",
        "clean_search": f"CASE WHEN NOT {p}full AND {p}main = '' AND {p}search = '' THEN {b('search')} "
        f"ELSE concat(substring({p}search, 1, 1), {encoded(f'{p}query', QUERY_UNSAFE)}) END",
        "fragment": f"substring({p}hash, 2)",
        "clean_hash": f"concat(substring({p}hash, 1, 1), {encoded(f'{p}fragment', FRAGMENT_UNSAFE)})",
    }
    df = df.selectExpr("*", *[f"{e} AS {p}{n}" for n, e in steps.items()])
    done = {
        "href": f"concat({p}scheme, '://', {p}authority, {p}clean_path, {p}clean_search, {p}clean_hash)",
        "scheme": f"{p}scheme",
        "authority": f"{p}authority",
        "host": f"{p}host",
        "path": f"{p}clean_path",
        "search": f"{p}clean_search",
    }
    return pin(df, {f"{out}_{n}": F.expr(f"CASE WHEN {p}ok THEN {e} END") for n, e in done.items()}, drop=p)


def origin(prefix: str) -> Column:
    """Scheme, host and port of a resolved URL; no user part."""
    return F.concat(
        F.col(f"{prefix}_scheme"),
        F.lit("://"),
        F.regexp_replace(F.col(f"{prefix}_authority"), r"^.*@", ""),
    )
