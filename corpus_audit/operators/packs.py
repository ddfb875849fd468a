"""Rules as data, and the built-in packs.

Patterns stay in the subset that Java and RE2 read alike: no look-around, no back-references.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UI_PATH = r"\.(tsx|jsx|vue|html)$"
SERVER_PATH = r"\.(ts|js|py|go|java)$"


class Rule(NamedTuple):
    rule_id: str
    axiom: int
    severity: str
    owasp: str | None
    line_regex: str
    message: str
    path_regex: str | None = None
    lang: str | None = None
    also_regex: str | None = None
    # Lower-case literals; a line with none of them cannot match, which is cheaper to see than the pattern.
    needs: tuple[str, ...] = ()
    # Whether text behind a comment sign counts too: a leaked key is leaked wherever it stands, and prose has no comments.
    in_comments: bool = False


RULES = (
    Rule("RUL-01", 5, "Critical", "A04",
         r"""(?i)(api[_-]?key|secret|passw(or)?d|token)[a-z0-9_]*["']?[ \t]*[:=][ \t]*["'][^"']{6,}["']""",
         "hardcoded credential", needs=("key", "secret", "passw", "token"), in_comments=True),
    Rule("RUL-02", 5, "High", "A07", r"(?i)https?://[^ \"']*[?&](access_token|api_key|token|key|secret|password)=",
         "secret in a URL query string", needs=("http",), in_comments=True),
    Rule("RUL-03", 5, "High", "A04",
         r"(?i)(createHash\([ \t]*[\"'](md5|sha1)[\"']|hashlib\.(md5|sha1)\(|MessageDigest\.getInstance\(\"(MD5|SHA-1)\"|createCipheriv\([\"'](des|rc4))",
         "weak hash or cipher", needs=("md5", "sha1", "sha-1", "des", "rc4")),
    Rule("RUL-05-eval", 5, "Critical", "A05", r"(^|[^A-Za-z0-9_.])(eval|exec|execSync|os\.system|new Function)\(",
         "dynamic code or command execution", needs=("eval(", "exec", "os.system(", "new function(")),
    Rule("RUL-05-html", 5, "High", "A05", r"(dangerouslySetInnerHTML|\.innerHTML[ \t]*=|document\.write\()",
         "raw HTML sink", needs=("innerhtml", "document.write(")),
    Rule("RUL-05-load", 5, "High", "A08", r"(pickle\.loads?\(|yaml\.load\(|unserialize\(|ObjectInputStream\()",
         "unsafe deserialization", needs=("load", "unserialize(", "objectinputstream(")),
    Rule("RUL-06", 5, "High", "A09", r"(console\.(log|info|debug)|print|logger\.[a-z]+)[ \t]*\(",
         "sensitive data written to a log",
         also_regex=r"(?i)(password|passwd|secret|token|authorization|ssn|email|JSON\.stringify\(|[(, ](req|request|ctx)[,.)])", needs=("console.", "print", "logger.")),
    Rule("RUL-07-server", 3, "Medium", None, r"(^|[^A-Za-z0-9_.])(console\.(log|info|debug)|print)[ \t]*\(",
         "raw standard output in a server file, use the structured logger", path_regex=SERVER_PATH, needs=("console.", "print")),
    Rule("RUL-07-ui", 3, "Low", None, r"(^|[^A-Za-z0-9_.])(console\.(log|info|debug)|print)[ \t]*\(",
         "stray debug log in a UI file", path_regex=UI_PATH, needs=("console.", "print")),
    Rule("RUL-08", 5, "Medium", "A10",
         r"(?i)(send|json|write|end|render)\(.*(err|error|e|exception)\.(stack|message)|traceback\.format_exc\(",
         "error details leak to the client", needs=(".stack", ".message", "format_exc(")),
    Rule("RUL-09", 5, "Medium", "A02",
         r"(?i)(debug[\"']?[ \t]*[:=][ \t]*true|rejectUnauthorized[ \t]*:[ \t]*false|verify[ \t]*=[ \t]*False|Access-Control-Allow-Origin.*\*)",
         "insecure default or debug switch", path_regex=r"^(src|app|lib|server|docs)/", needs=("debug", "rejectunauthorized", "verify", "access-control")),
    Rule("RUL-11", 5, "High", "A01",
         r"(=[ \t]*(req|request|ctx)\.(params|query|body)|(req|request|ctx)\.(params|query|body)\.[A-Za-z]*[iI]d)",
         "identity taken from the client", needs=("params", "query", "body")),
    Rule("RUL-13-ts", 3, "Medium", None, r"(:[ \t]*any\b|<any>|[ \t]as[ \t]+any\b|@ts-ignore|@ts-nocheck)",
         "type checker bypassed", path_regex=r"\.(ts|tsx)$", needs=("any", "@ts-")),
    Rule("RUL-13-py", 3, "Medium", None, r"(type:[ \t]*ignore|:[ \t]*Any\b|typing\.cast\()",
         "type checker bypassed", path_regex=r"\.py$", needs=("ignore", "any", "cast(")),
    Rule("RUL-13-go", 3, "Medium", None, r"interface\{\}", "empty interface", path_regex=r"\.go$", needs=("interface{}",)),
    Rule("RUL-17-sync", 4, "Medium", None, r"(readFileSync|writeFileSync|existsSync|execSync)\(",
         "synchronous I/O", needs=("sync(",)),
    Rule("RUL-17-unbounded", 4, "Medium", None, r"Promise\.all\([A-Za-z0-9_.]+\.map\(",
         "unbounded parallel awaits", needs=("promise.all(",)),
    Rule("RUL-17-timeout", 4, "Low", None, r"(fetch|axios\.(get|post)|requests\.(get|post))\([^)]*\)",
         "external call without a timeout", needs=("fetch(", "axios.", "requests.")),
    Rule("RUL-19", 5, "Medium", "A06", r"(?i)(localStorage|sessionStorage|document\.cookie).*(token|secret|password|session)",
         "sensitive state kept on the client", path_regex=UI_PATH, needs=("storage", "cookie")),
    Rule("RUL-24-email", 5, "Medium", "A09", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "personal data: e-mail address", path_regex=r"^docs/", needs=("@",), in_comments=True),
    Rule("RUL-24-phone", 5, "Medium", "A09", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
         "personal data: phone number", path_regex=r"^docs/", needs=("+",), in_comments=True),
    Rule("RUL-24-ip", 5, "Low", "A09", r"(^|[^0-9.])[0-9]{1,3}(\.[0-9]{1,3}){3}",
         "personal data: network address", path_regex=r"^docs/", needs=(".",), in_comments=True),
)

# Kinds of personal data for the triage counts.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "phone": r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
}

def pack(*prefixes: str) -> list[Rule]:
    """Built-in rules whose id is one of ``prefixes`` or a variant of it; all of them without arguments."""
    if not prefixes:
        return list(RULES)
    return [r for r in RULES if any(r.rule_id == p or r.rule_id.startswith(p + "-") for p in prefixes)]


def for_axiom(rules: list[Rule], axiom: int) -> list[Rule]:
    return [r for r in rules if r.axiom == axiom]


def for_language(rules: list[Rule], lang: str) -> list[Rule]:
    """The adapter of one language: its own rules and those for every language."""
    return [r for r in rules if r.lang in (None, lang)]


# Rules that become code; larger packs stay tables (``pack_index``).
MOST_COMPILED = 2000


def load_pack(table: DataFrame) -> list[Rule]:
    """Rules from a table, as code.  They are counted first; more than ``MOST_COMPILED`` are for :func:`pack_index.scan_pack`."""
    columns = [c for c in Rule._fields if c in table.columns]
    rows = table.select(*columns).limit(MOST_COMPILED + 1).collect()
    if len(rows) > MOST_COMPILED:
        raise ValueError(f"more than {MOST_COMPILED} rules: scan them as a table with pack_index.scan_pack")
    return [Rule(**{"owasp": None, **row, "needs": tuple(row.get("needs") or ()), "in_comments": bool(row.get("in_comments"))})
            for row in sorted((row.asDict() for row in rows), key=lambda row: row["rule_id"])]


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """The pack as a table, the counterpart of :func:`load_pack`."""
    return spark.createDataFrame(
        [(*r[:-2], list(r.needs), r.in_comments) for r in rules],
        "rule_id string, axiom int, severity string, owasp string, line_regex string, message string, path_regex string, "
        "lang string, also_regex string, needs array<string>, in_comments boolean").orderBy(F.col("rule_id"))
