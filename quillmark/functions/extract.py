"""Extraction of tokens, addresses and paths from text by patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.scalars import ocr_text, squeeze

# Patterns of evidence in terminal output.  Boundaries are those of ASCII words, so that a token
# beside a Chinese character counts.
_A, _Z = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
EVIDENCE = [
    _A + r"(\d{1,3}(?:\.\d{1,3}){3})" + _Z,
    _A + r"(nc +-[a-z]+ +\d+)" + _Z,
    r"(?i)(listening on +\S+(?: +\d+)?)",
    r"(?i)(connection received on +\S+)",
    r"(?i)(docker(?:[ -]compose)? +[a-z]+)",
    r"([A-Za-z0-9_-]+\.war)" + _Z,
    r"((?:ldap|rmi)://[^\s|]+)",
    r"(https?://[^\s|<>\"']+)",
]

# The reference's patterns, over text in lower case with single blanks; \b is the edge of an ASCII word.
REFERENCE_EVIDENCE = [
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"\b(?:nc|ncat) +-[a-z]* *(?:\d{2,5})\b",
    r"\blistening on (?:\d{1,3}\.){3}\d{1,3} \d{2,5}\b",
    r"\bconnection received on (?:\d{1,3}\.){3}\d{1,3} \d{2,5}\b",
    r"\bdocker compose up --build\b",
    r"\bcommand 'docker' not found\b",
    r"\b(?:apt install )?(?:docker\.io|podman-docker)\b",
    r"\bbuilding war: *[^ ]+\.war\b",
    r"\b[A-Za-z0-9_.-]+\.war\b",
    r"\b(?:ldap|rmi|http)://[^ \"'<>]+",
    r"/(?:rce|uvvvi|exec|exectemplate)[A-Za-z0-9_.-]*",
    r"\bexectemplatejdk8(?:\.class)?\b",
    r"\brce[-_][a-z0-9_-]+",
    r"\bsqli\b",
]
# Every pattern with an edge begins and ends with a word character there.
_FIRST, _LAST = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def evidence_tokens(text: Column) -> Column:
    """The set of evidence tokens in lower case, blanks squeezed; an empty set for a null text."""
    t = F.coalesce(text, F.lit(""))
    found = F.flatten(F.array(*[all_matches(t, p) for p in EVIDENCE]))
    return F.array_distinct(F.transform(found, lambda x: F.lower(squeeze(x))))


def reference_tokens(text: Column) -> Column:
    """The set of the reference's evidence tokens; an empty set for a null text."""
    t = F.lower(squeeze(F.coalesce(text, F.lit(""))))
    found = [F.regexp_extract_all(t, F.lit(re.sub(r"^\\b", lambda _: _FIRST, p).replace(r"\b", _LAST)), F.lit(0)) for p in REFERENCE_EVIDENCE]
    return F.array_distinct(F.flatten(F.array(*found)))


def urls_in(text: Column, most: int = 20) -> Column:
    """The first ``most`` different URLs of a text without what closes them."""
    found = all_matches(F.coalesce(text, F.lit("")), r"(https?://[^\s<>\"'）)\]，。、|]+)")
    return F.slice(F.array_distinct(found), 1, most)


def long_numbers(text: Column, digits: int = 10) -> Column:
    """The different numbers of exactly ``digits`` digits."""
    return F.array_distinct(all_matches(F.coalesce(text, F.lit("")), rf"(?<![0-9])([0-9]{{{digits}}})(?![0-9])"))


def base64_pieces(text: Column, least: int = 24) -> Column:
    """Decoded base64 runs of at least ``least`` characters that decode to mostly printable text."""
    runs = F.array_distinct(all_matches(F.coalesce(text, F.lit("")), rf"([A-Za-z0-9+/]{{{least},}}={{0,2}})"))
    whole = F.transform(runs, lambda x: F.regexp_replace(x, "=+$", ""))
    # Padding made good; one character left over tells nothing.
    whole = F.transform(whole, lambda x: F.substring(x, F.lit(1), (F.length(x) - F.when(F.length(x) % 4 == 1, 1).otherwise(0)).cast("int")))
    plain = F.transform(whole, lambda x: F.decode(F.unbase64(F.rpad(x, F.ceil(F.length(x) / 4).cast("int") * 4, "=")), "UTF-8"))
    shown = F.filter(plain, lambda x: (F.length(x) >= 8) & (F.length(F.regexp_replace(x, r"[^\x20-\x7e\s]", "")) > 0.75 * F.length(x)))
    return shown


# How OCR misreads addresses, over text in lower case with single blanks.
MISREAD = [
    (r"h *t *t *p *s? *:", "http:"),
    (r"htps:", "https:"),
    (r"httos:", "https:"),
    (r"hittp:", "http:"),
]
MISREAD_HOSTS = [
    (r"(\d{1,3}\.\d{1,3}\.\d{1,3}) +(\d{1,3}) *[;:] *(\d{2,5}) *[v\\/|]? *", "$1.$2:$3/"),
    (r"((?:\d{1,3}\.){3}\d{1,3}) *[;] *(\d{2,5})", "$1:$2"),
]
MISREAD_PATHS = [
    (r"\s+", ""),
    (r"^[^0-9a-z/]*(?=(?:\d{1,3}\.){2}\d{1,3})", ""),
    (r"^(?:nitpir|nttp|nhttp|hittp|httpi)(?=\d)", "http://"),
    (r"([:]\d{2,5})[v|](?=(?:ex|sqli|campus|upload|session|phone))", "$1/"),
    (r"(?:exmonine|examonine|exammine/?online|exammine|examoniine|exam0nline|examineonline)", "examonline"),
    (r"/?examonline(?=[a-z0-9_-])", "/examonline/"),
    (r"(?:snel|shel1|sheil|hell)(?=[_.-]?\d|\b)", "shell"),
    (r"[),.;，。；]+$", ""),
]
# What counts as an address or a path, what is noise.
_STOP = r"[^\s'\"<>，。；]"
PATHS = [
    rf"https?: */{{0,2}}{_STOP}+",
    rf"(?:(?:\d{{1,3}}\.){{3}}\d{{1,3}}:\d{{2,5}}|localhost:\d{{2,5}}){_STOP}*",
    rf"(?:(?:\d{{1,3}}[. ]){{3}}\d{{1,3}} *[;:] *\d{{2,5}}){_STOP}*",
    rf"/(?:examonline|sqli|upload|uploads|session|phoneshop|campusbbs)/{_STOP}*",
    r"/(?:hack|hacks|shell|sh3ll|sshell|memshell|behinderfilter)[\w.-]*(?:[,.]?(?:jsp|jspx|txt|do|action|tet|ixt))?\b",
    r"\b(?:shell|shel1|sh3ll|hack|hacks|memshell|behinderfilter)[\w.-]*(?:\.(?:jsp|jspx|txt|do|action|tet|ixt))?\b",
]
SHELL_PATHS = [
    *PATHS[:2],
    rf"/(?:examonline|sqli|upload|session|phoneshop|campusbbs)/{_STOP}*",
    r"\b(?:shell|shel1|sh3ll|hack|dsb|memshell|behinderfilter)[\w.-]*(?:\.(?:jsp|jspx|txt|do|action))?\b",
]
NOISE = r"apache|tomcat-|java\.oracle|closer\.cgi|tar\.gz|register\.html|login\.html|web-inf|meta-inf|/css\b"
SHELL_SIGN = r"shell|shel1|sh3ll|hack|dsb|memshell|behinderfilter|\.jsp|\.jspx|\.txt|/examonline/[a-z0-9_-]{2,}"
WEAK_NAMES = r"^(?:shell|shel1|sh3ll|shell\.jsp|hack|hacks|hack1234|dsb|wx|exam|style|2026|38)$"
ENDINGS = r"\.(?:jsp|jspx|txt|do|action|tet|ixt)"


def _replaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def _matches(text: Column, patterns: list[str]) -> Column:
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]))


def repaired_path(value: Column) -> Column:
    """A path as OCR read it, its usual misreadings put right, without closing marks."""
    return _replaced(value, MISREAD_HOSTS + MISREAD_PATHS)


def meaningful_path(value: Column) -> Column:
    """Whether a path is more than the beginning of an address."""
    bare = F.regexp_replace(value, r"\s+", "")
    return (bare != "") & ~bare.rlike(r"^https?:?/?$") & ~bare.rlike(r"^https?://(?:www|java_oracle)$") & ~bare.rlike(r"^(?:http:)?(?:weww|www)$")


def paths_in(text: Column, most: int = 20) -> Column:
    """The first ``most`` different addresses and paths of an OCR text, repaired, without noise."""
    t = _replaced(ocr_text(text), MISREAD + MISREAD_HOSTS)
    found = F.transform(_matches(t, PATHS), repaired_path)
    return F.slice(F.array_distinct(F.filter(found, lambda x: meaningful_path(x) & ~x.rlike(NOISE))), 1, most)


def shell_pieces(text: Column, most: int = 8) -> Column:
    """The first ``most`` different addresses and names of uploaded shells in an OCR text."""
    found = F.transform(_matches(_replaced(ocr_text(text), MISREAD), SHELL_PATHS), lambda x: F.regexp_replace(x, r"\s+", ""))
    return F.slice(F.array_distinct(F.filter(found, lambda x: (x != "") & ~x.rlike(NOISE) & x.rlike(SHELL_SIGN))), 1, most)


def strong_piece(piece: Column, student_no: Column) -> Column:
    """Whether a piece names a shell of this student: by number or its last two digits, or by a name of its own."""
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(piece, r"^https?: */", "http://"), r"\s+", ""), r"[),.;，。；]+$", "")
    tail = F.regexp_replace(F.regexp_replace(F.element_at(F.split(v, "/examonline/"), -1), r"[?#].*$", ""), r"^/+|/+$", "")
    weak = tail.rlike(WEAK_NAMES) | F.regexp_replace(tail, ENDINGS + "$", "").rlike(WEAK_NAMES)
    no = F.coalesce(student_no, F.lit(""))
    last = F.regexp_replace(F.right(no, F.lit(2)), r"([^0-9A-Za-z])", r"\\$1")
    by_number = (no != "") & F.contains(v, no)
    by_digits = (F.length(no) >= 2) & F.regexp_like(v, F.concat(F.lit("(?:shell|shel1|sh3ll|hack|memshell|filter)[_.-]?"), last, F.lit(r"(?:\D|$)")))
    named = v.rlike(r"(?:shell|shel1|sh3ll|memshell|behinderfilter|filter)[\w.-]{2,}")
    placed = v.rlike(r"https?:|(?:\d{1,3}\.){3}:\d+|localhost:\d+|/examonline/") & v.rlike(r"/examonline/[a-z][a-z0-9_-]{3,}")
    return (v != "") & ~weak & (by_number | by_digits | named | placed)


# Fixed value: words that make a line of a rubric worth keeping.
RUBRIC_WORDS = "实验目标|代码审计|漏洞|利用|成功|截图|修复|验证|payload|回显|回连|上传|注入|反序列化|gadget|cookie|xss|ssrf|sql|命令|反射|内存马|逻辑漏洞|评分|提交"


def rubric_lines(text: Column, first: int = 20, most_chars: int = 9000) -> Column:
    """The lines of a rubric that hold one of its words, and others while under ``first`` are kept; nothing after
    the line that brings the kept text over ``most_chars``."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(-1).alias("chars"))

    def step(acc: Column, line: Column) -> Column:
        take = (acc["chars"] <= most_chars) & (line.rlike(f"(?i){RUBRIC_WORDS}") | (F.size(acc["kept"]) < first))
        kept = F.when(take, F.concat(acc["kept"], F.array(line))).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), (acc["chars"] + F.when(take, F.length(line) + 1).otherwise(0)).alias("chars"))

    return F.aggregate(lines, start, step)["kept"]


def form_score(fields: Column, fallback: Column) -> Column:
    """The value of the first form field named score and a number, else ``fallback``; '' for none."""
    found = F.filter(fields, lambda f: f["name"].rlike(r"^score\d+$"))
    return F.coalesce(F.nullif(F.get(found, F.lit(0))["value"], F.lit("")), F.nullif(fallback, F.lit("")), F.lit(""))
