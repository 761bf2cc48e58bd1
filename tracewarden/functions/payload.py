"""Payload classification columns. All of them are JVM expressions; only inflating needs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret shapes, tried in this order; the label never carries the value.
SECRET_PATTERNS = [
    ("private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws access key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("aws secret key assignment", r"(?i)aws_secret_access_key\s*[:=]\s*[A-Za-z0-9/+=]{40}"),
    ("model api key", r"\b(sk|sk-ant|sk-proj)-[A-Za-z0-9_\-]{20,}"),
    ("github token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack token", r"\bxox[baprs]-[A-Za-z0-9\-]{10,}"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{10,}\.eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}"),
    (
        "credential assignment",
        r"""(?i)(api[_-]?key|secret|password|passwd|token)\s*[:=]\s*["'][^"']{12,}["']""",
    ),
]

# How a line of code begins, and the file endings a listing may mention.
CODE_PREFIXES = [
    "fn ", "pub fn ", "pub(crate) fn ", "async fn ", "def ", "class ", "function ", "import ",
    "from ", "use ", "package ", "const ", "let ", "export ", "func ", "impl ", "pub struct ",
    "struct ", "pub enum ", "enum ", "trait ", "interface ", "#include", "#[", "///", "@Override",
]
SOURCE_EXTENSIONS = [
    ".rs", ".ts", ".tsx", ".js", ".py", ".go", ".java", ".c", ".cpp", ".h", ".rb", ".php",
    ".swift", ".kt", ".sh", ".sql", ".yml", ".yaml", ".toml",
]

# What a setting's key must contain to name an endpoint.
ENDPOINT_KEYS = [
    "base_?url", "api_?url", "endpoint", "upload", "ingest", "telemetry", "report_?url", "api_?host",
    "server_?url", "collector", "beacon",
]
# any key bound to a quoted http(s) URL; starting only at word starts keeps the search linear
BOUND_URL_PATTERN = (
    r"""(?i)(?<![a-z0-9_])([a-z0-9_]++)["']?\s*[:=]\s*["'](https?://([a-z0-9][a-z0-9._-]{2,253}))"""
)
PREVIEW_BYTES = 8192
#: Fixed value: shorter bodies are words, not base64.
BASE64_MIN_BYTES = 256
_SPECIALS = str.maketrans({c: "\\" + c for c in r"\.()[]{}#@/+*?^$|"})
CODE_LINE_PATTERN = (
    r"(?m)^[ \t\r\f\x0B]*(?:" + "|".join(p.translate(_SPECIALS) for p in CODE_PREFIXES) + ")"
)
STRUCTURAL_LINE_PATTERN = r"(?m)[{};]\r?$"
PATH_LINE_PATTERN = r"""(?m)^.*(?:/src/|\.rs"|\.ts"|\.py").*$"""


def _unix(pattern: str) -> str:
    """Java: let ``^``, ``$`` and ``.`` treat only line feeds as line ends."""
    return pattern.replace("(?m)", "(?md)", 1)


# What a text must contain for the pattern of the same position to have a chance. Substring search
# works on the stored bytes, so most texts never reach a regex.
_SECRET_HINTS = [
    ["PRIVATE KEY-----"],
    ["AKIA"],
    [],
    ["sk-"],
    ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    ["xox"],
    [".eyJ"],
    [],
]
_QUOTED_VALUE = r"""[:=]\s*["'][^"']{12}"""


def detect_secret(text: Column, scan_chars: int | None = None) -> Column:
    """Kind of the first matching secret shape, or null. The whole text is searched unless bounded."""
    head = F.substring(text, 1, scan_chars) if scan_chars else text
    out = F.lit(None).cast("string")
    for (label, pattern), hints in reversed(list(zip(SECRET_PATTERNS, _SECRET_HINTS))):
        if hints:
            likely = head.contains(hints[0])
            for hint in hints[1:]:
                likely = likely | head.contains(hint)
        elif label == "credential assignment":
            likely = (head.contains('"') | head.contains("'")) & head.rlike(_QUOTED_VALUE)
        else:
            likely = F.lower(head).contains("aws_secret_access_key")
        out = F.when(likely & head.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def line_count(text: Column) -> Column:
    """Number of lines; a final line feed does not open another line."""
    feeds = F.length(text) - F.length(F.translate(text, "\n", ""))
    return feeds + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)


def is_code_keyword_line(line: Column) -> Column:
    return F.ltrim(line).rlike(CODE_LINE_PATTERN.replace("(?m)", ""))


def looks_like_source(text: Column, sample_lines: int | None = None, sample_chars: int | None = None) -> Column:
    """Code-or-prose score over line statistics, each counted by one regex pass without splitting."""
    if sample_chars:
        text = F.substring(text, 1, sample_chars)
    if sample_lines:
        text = F.substring_index(text, "\n", sample_lines)
    lines = line_count(text)

    def per_hundred(n: Column) -> Column:
        return F.floor(n * 100 / F.greatest(lines, F.lit(1)))

    keyword = F.regexp_count(text, F.lit(_unix(CODE_LINE_PATTERN)))
    structural = F.regexp_count(text, F.lit(_unix(STRUCTURAL_LINE_PATTERN)))
    path_like = F.regexp_count(text, F.lit(_unix(PATH_LINE_PATTERN)))
    punctuation = F.length(text) - F.length(F.translate(text, "{};", ""))

    def point(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    score = (
        F.lit(1)
        + point(keyword >= 8)
        + point(per_hundred(keyword) >= 30)
        + point(per_hundred(structural) >= 25)
        + point(per_hundred(punctuation) >= 120)
        + point(text.contains("::") | text.contains("->") | text.contains("};"))
        + point(path_like >= 2)
    )
    big_enough = (F.octet_length(text) >= 64) & (lines >= 5)
    any_keyword = text.rlike(_unix(CODE_LINE_PATTERN))
    gate = (keyword >= 8) | (per_hundred(keyword) >= 30)
    # nested WHENs: the later, dearer counts run only for rows that pass the earlier tests
    return F.when(~big_enough, False).when(~any_keyword, False).when(~gate, False).otherwise(score >= 3)


def describe_source(text: Column) -> Column:
    """Line count plus up to five source file endings that occur in the text."""
    endings = F.array_compact(F.array(*[F.when(text.contains(e), F.lit(e)) for e in SOURCE_EXTENSIONS]))
    lines = line_count(text).cast("string")
    return F.when(
        F.size(endings) == 0, F.concat(F.lit("possible source fragment ("), lines, F.lit(" lines)"))
    ).otherwise(
        F.concat(
            F.lit("possible source ("), lines, F.lit(" lines, mentions "),
            F.array_join(F.slice(endings, 1, 5), " "), F.lit(")"),
        )
    )


def archive_kind(body: Column) -> Column:
    """zip, tar, 7z, rar or null, by magic bytes."""
    head = F.hex(F.substring(body, 1, 6))
    return (
        F.when(head.startswith("504B0304"), F.lit("zip"))
        .when(F.hex(F.substring(body, 258, 5)) == F.lit("7573746172"), F.lit("tar"))
        .when(head == "377ABCAF271C", F.lit("7z"))
        .when(head.startswith("52617221"), F.lit("rar"))
    )


def looks_compressed(body: Column) -> Column:
    """gzip or zlib magic."""
    head = F.hex(F.substring(body, 1, 2))
    return (F.octet_length(body) > 2) & head.isin("1F8B", "7801", "785E", "789C", "78DA")


def _latin1(body: Column) -> Column:
    """One character per byte."""
    return F.decode(body, "ISO-8859-1")


def looks_base64(body: Column, limit_bytes: int | None = None) -> Column:
    """At least 256 bytes of which 98 in 100 are alphabet characters, over the whole body."""
    size = F.octet_length(body)
    text = _latin1(body)
    # fails at the first character that could not be decoded, for most texts within a word or two
    decodable = text.rlike(r"^[A-Za-z0-9+/ \t\n\r\f]*+(?:=|$)")
    allowed = F.length(F.regexp_replace(text, r"[^A-Za-z0-9+/=\n\r]", ""))
    fits = size >= BASE64_MIN_BYTES
    if limit_bytes is not None:
        fits &= size <= limit_bytes
    return fits & decodable & (F.floor(allowed * 100 / F.length(text)) >= 98)


def decode_base64(body: Column, limit_bytes: int | None = None) -> Column:
    """Decoded bytes of a base64 payload (white space skipped, padding optional), else null."""
    compact = F.regexp_replace(_latin1(body), r"[ \t\n\r\f]", "")
    digits = F.substring_index(compact, "=", 1)
    spare = F.length(digits) % 4
    whole = F.when(spare == 1, F.substring(digits, F.lit(1), F.length(digits) - 1)).otherwise(digits)
    padded = F.concat(whole, F.when(spare == 2, F.lit("==")).when(spare == 3, F.lit("=")).otherwise(F.lit("")))
    valid = looks_base64(body, limit_bytes) & digits.rlike(r"^[A-Za-z0-9+/]{2,}$")
    return F.when(valid, F.unbase64(padded))


def utf8_text(body: Column) -> Column:
    """The body as text, or null when it is not valid UTF-8."""
    return F.try_validate_utf8(body.cast("string"))


def mostly_printable(body: Column) -> Column:
    """More than 90 % of the bytes are visible ASCII or white space."""
    text = _latin1(body)
    printable = F.length(F.regexp_replace(text, r"[^\x21-\x7E \t\n\r\f]", ""))
    return (F.length(text) > 0) & (F.floor(printable * 100 / F.length(text)) > 90)


def stored_body(body: Column, max_bytes: int) -> Column:
    """Bounded text form of a body; null when empty, holding NUL, or under 90 % printable."""
    text = F.make_valid_utf8(F.substring(body, 1, max_bytes).cast("string"))
    total = F.length(text)
    printable = total - F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"))
    keep = (total > 0) & ~text.contains("\x00") & (F.floor(printable * 100 / total) >= 90)
    return F.when(keep, text)


def text_preview(body: Column) -> Column:
    return stored_body(body, PREVIEW_BYTES)


def body_sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def endpoint_matches(text: Column) -> Column:
    """``array<struct<key,host,url,pos>>``: every endpoint setting of a text, in order.

    A key counts if its name is endpoint-shaped; one that merely ends in ``url`` counts as ``url``,
    and only for hosts that look like an API.
    """
    # one pass over the text; the short matches are then taken apart
    found = F.transform(
        F.regexp_extract_all(text, F.lit(BOUND_URL_PATTERN), F.lit(0)),
        lambda m, i: F.struct(
            F.lower(F.regexp_extract(m, "^([A-Za-z0-9_]+)", 1)).alias("word"),
            F.lower(F.rtrim(F.regexp_extract(m, "(?i)https?://(.*)$", 1), F.lit("."))).alias("host"),
            F.regexp_extract(m, "(?i)(https?://.*)$", 1).alias("url"),
            i.alias("pos"),
        ),
    )
    shaped = "|".join(ENDPOINT_KEYS)

    def keep(e: Column) -> Column:
        return e["word"].rlike(shaped) | (e["word"].endswith("url") & e["host"].rlike("api|upload|ingest"))

    def named(e: Column) -> Column:
        key = F.when(e["word"].rlike(shaped), e["word"]).otherwise("url")
        return F.struct(key.alias("key"), e["host"].alias("host"), e["url"].alias("url"), e["pos"].alias("pos"))

    return F.transform(F.filter(found, keep), named)


def extract_endpoints(text: Column) -> Column:
    """The first of ``endpoint_matches`` per host, in text order.

    Sorted by host and position, a match is its host's first if the one before it has another host; each is compared with its
    neighbour only. Where rows are grouped anyway, group ``endpoint_matches`` instead.
    """
    by_host = F.array_sort(
        F.transform(endpoint_matches(text), lambda e: F.struct(e["host"].alias("host"), e["pos"].alias("pos"), e["key"].alias("key"), e["url"].alias("url")))
    )
    before = F.concat(F.array(F.lit(None).cast("struct<host:string,pos:int,key:string,url:string>")), by_host)
    first = F.filter(F.arrays_zip(by_host.alias("own"), before.alias("before")), lambda p: p["own"].isNotNull() & ~p["own"]["host"].eqNullSafe(p["before"]["host"]))
    in_order = F.array_sort(F.transform(first, lambda p: F.struct(p["own"]["pos"].alias("pos"), p["own"]["key"].alias("key"), p["own"]["host"].alias("host"), p["own"]["url"].alias("url"))))
    return F.transform(in_order, lambda e: F.struct(e["key"].alias("key"), e["host"].alias("host"), e["url"].alias("url"), e["pos"].alias("pos")))
