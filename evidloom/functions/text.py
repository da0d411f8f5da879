"""Column expressions over text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidloom import vocab

TOKEN = "[A-Za-z0-9]+"


def tokens(text: Column) -> Column:
    """lower-cased runs of ASCII letters and digits, in order, repeats kept.

    Lower-casing comes after matching, so characters that only become ASCII by lower-casing do
    not turn into tokens.
    """
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def token_count(text: Column) -> Column:
    """Number of F1 tokens without building the array."""
    return F.regexp_count(text, F.lit(TOKEN))


@F.pandas_udf(StringType())
def _normalise_unicode(text: pd.Series) -> pd.Series:
    return text.map(
        lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split())
    )


def normalise(text: Column) -> Column:
    """NFC and single spaces.  ASCII rows stay in the JVM; the Arrow function receives NULL
    for them, so only the other rows carry text to Python."""
    ascii_only = ~text.rlike(r"[^\x00-\x7f]")
    fast = F.regexp_replace(
        F.regexp_replace(text, r"[\s\x1c-\x1f]+", " "), r"^ | $", ""
    )
    return F.when(ascii_only, fast).otherwise(_normalise_unicode(F.when(~ascii_only, text)))


# Unicode white space plus the separator controls that the rules also strip.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def doi(value: Column) -> Column:
    """trimmed, lower-cased DOI without one resolver or scheme prefix."""
    return F.regexp_replace(F.lower(strip(value)), r"^(https?://doi\.org/|doi:)", "")


def title_key(value: Column) -> Column:
    """trimmed, lower-cased, whitespace runs as one space."""
    return F.regexp_replace(F.lower(strip(value)), SPACE, " ")


def author_list(values: Column) -> Column:
    """trimmed names, blank ones dropped, letter case kept."""
    return F.filter(F.transform(values, lambda a: strip(a)), lambda a: a != "")


def find_anchor(text: Column, anchor: Column) -> Column:
    """zero-based offset of the first occurrence, NULL when absent."""
    at = F.position(anchor, text)
    return F.when(at > 0, at - 1)


def page_of(coords: Column) -> Column:
    """page is the first comma part of a coordinate string."""
    return F.when(coords != "", F.split_part(coords, F.lit(","), F.lit(1)))


def text_fingerprint(text: Column) -> Column:
    """sha256 of the UTF-8 text."""
    return F.sha2(text, 256)


def parse_fingerprint(content: Column, parser: str) -> Column:
    """sha256 of the bytes followed by the parser name."""
    return F.sha2(F.concat(content.cast("binary"), F.lit(parser).cast("binary")), 256)


def document_id(fingerprint: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(fingerprint, 1, 16))


def request_fingerprint(*fields: Column) -> Column:
    """sha256 of the JSON form with the given field order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def md5_uuid(value: Column) -> Column:
    """md5 written as UUID text."""
    return F.regexp_replace(
        F.md5(value), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def instant(value: Column) -> Column:
    """ISO-8601 instant, ``Z`` accepted."""
    return F.to_timestamp(value)


def source_key(workspace: Column, sha: Column) -> Column:
    """content-addressed object key of a source asset."""
    return F.concat(
        F.lit("workspaces/"), workspace, F.lit("/source-assets/"), F.substring(sha, 1, 2),
        F.lit("/"), sha, F.lit(".pdf"),
    )


def structured_text_key(workspace: Column, fingerprint: Column) -> Column:
    """object key of the structured text of an asset."""
    return F.concat(F.lit("workspaces/"), workspace, F.lit("/tei/"), fingerprint, F.lit(".xml"))


def state_percent(status: Column) -> Column:
    """progress percent of a lifecycle state."""
    pairs = [F.lit(x) for kv in vocab.STATE_PERCENT.items() for x in kv]
    return F.element_at(F.create_map(*pairs), status)


def is_terminal(status: Column) -> Column:
    return status.isin(*vocab.TERMINAL_STATES)


def redact(text: Column) -> Column:
    """Five secret patterns, replaced in order."""
    out = text
    for pattern, replacement in vocab.REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def redaction_hits(text: Column) -> list[Column]:
    """Hits per pattern, each counted on the text as the earlier patterns left it."""
    hits, out = [], text
    for i, (pattern, replacement) in enumerate(vocab.REDACTIONS, start=1):
        hits.append(F.regexp_count(out, F.lit(pattern)).alias(f"hits_{i}"))
        out = F.regexp_replace(out, pattern, replacement)
    return hits


def sanitise_markup(text: Column) -> Column:
    """Drop embedding tags.

    The first pattern only matches a closing ``</>``, as in the rule it reproduces; closing tags
    such as ``</script>`` therefore stay.
    """
    out = text
    for pattern in vocab.MARKUP_PATTERNS:
        out = F.regexp_replace(out, pattern, "")
    return out


def has_injection_phrase(text: Column) -> Column:
    """Any of three phrases, case-insensitive."""
    low, hit = F.lower(text), F.lit(False)
    for phrase in vocab.INJECTION_PHRASES:
        hit = hit | low.contains(phrase)
    return hit


def _private_quad(a: Column, b: Column, c: Column) -> Column:
    """Private, loopback, link-local, multicast and reserved IPv4 blocks, by the first three octets."""
    return (
        a.isin(0, 10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
        | (a >= 224)
    )


def _private_groups(groups: Column) -> Column:
    """Whether eight IPv6 group values are not a public address."""
    g = [groups[i] for i in range(8)]
    zero = [x == 0 for x in g]
    head = zero[0] & zero[1] & zero[2] & zero[3] & zero[4]
    octets = [F.floor(g[6] / 256), g[6] % 256, F.floor(g[7] / 256)]
    # fixed values: non-public IPv6 blocks, and the IPv4 address inside a mapped one
    return (
        (head & zero[5] & zero[6] & g[7].isin(0, 1))
        | (head & (g[5] == 0xFFFF) & _private_quad(*octets))
        | ((g[0] >= 0xFC00) & (g[0] <= 0xFDFF)) | ((g[0] >= 0xFE80) & (g[0] <= 0xFEBF)) | (g[0] >= 0xFF00)
        | ((g[0] == 0x100) & zero[1] & zero[2] & zero[3])
        | ((g[0] == 0x64) & (g[1] == 0xFF9B) & (g[2] == 1))
        | ((g[0] == 0x2001) & ((g[1] < 0x200) | (g[1] == 0xDB8))) | (g[0] == 0x2002)
        | ((g[0] == 0x3FFF) & (g[1] < 0x1000)))


def _ipv6_groups(address: Column) -> Column:
    """Eight group values of an IPv6 literal; NULL when it is none.

    A dotted tail becomes two groups and ``::`` as many zero groups as are missing.
    """
    dotted = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    octet = [F.regexp_extract(address, dotted, i).try_cast("int") for i in range(1, 5)]
    tail = F.concat(F.hex(octet[0] * 256 + octet[1]), F.lit(":"), F.hex(octet[2] * 256 + octet[3]))
    plain = F.when(address.rlike(dotted), F.concat(F.regexp_replace(address, dotted, ""), tail)).otherwise(address)
    halves = F.split(plain, "::", -1)
    parts = lambda half: F.filter(F.split(half, ":"), lambda x: x != "")
    left, right = parts(F.get(halves, F.lit(0))), parts(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = F.lit(8) - F.size(left) - F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    values = F.transform(full, lambda x: F.conv(x, 16, 10).cast("int"))
    return F.when(plain.contains(":") & (F.size(full) == 8), values)


def url_denial(url: Column, require_https: bool = True) -> Column:
    """First static denial code of a URL, NULL when admitted.

    Name resolution is not part of this: only literal addresses are judged.
    """
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    user_info = F.regexp_extract(authority, r"^(.*)@", 1)
    host_port = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.regexp_extract(host_port, r"^(\[[^\]]*\]|[^:]*)", 1))
    # after the host only nothing or a colon with a number may follow; an empty number is the default
    tail = F.regexp_replace(host_port, r"^(\[[^\]]*\]|[^:]*)", "")
    port_text = F.regexp_replace(tail, "^:", "")
    default = F.when(scheme == "https", 443).otherwise(80)
    port = F.when(port_text == "", default).otherwise(
        F.when(port_text.rlike("^[0-9]+$"), F.coalesce(port_text.try_cast("int"), F.lit(-1))).otherwise(-1))
    quad = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    is_v4 = host.rlike(quad)
    a, b, c = (F.regexp_extract(host, quad, i).try_cast("int") for i in (1, 2, 3))
    v4_private = is_v4 & _private_quad(a, b, c)
    literal = F.regexp_extract(host, r"^\[([^\]%]*)(?:%[^\]]*)?\]$", 1)
    # bound once as a lambda variable: the group values are looked at many times
    v6_private = F.coalesce(
        F.get(F.transform(F.array(_ipv6_groups(literal)), _private_groups), F.lit(0)), F.lit(False))
    allowed = ["https"] if require_https else ["http", "https"]
    return (
        F.when(~scheme.isin(*allowed), "SCHEME_NOT_ALLOWED")
        .when((user_info != "") & (user_info != ":"), "CREDENTIALS_NOT_ALLOWED")
        .when(host == "", "HOST_NOT_ALLOWED")
        .when(~port.isin(80, 443), "PORT_NOT_ALLOWED")
        .when(v4_private | v6_private | (host == "localhost"), "PRIVATE_ADDRESS")
    )
