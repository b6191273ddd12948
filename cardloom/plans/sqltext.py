"""Pieces of DuckDB SQL that several statements share."""

from __future__ import annotations

from .. import rules

# What the statements match, written apart from the operators' code: orders to a model, as one alternation for RE2.
ORDERS = "(?is)" + "|".join([
    r"critical\s+instructions?\s+for\s+all\s+ai", r"\byou\s+must\s+(?:refuse|not|never)\b", r"\bas\s+an?\s+ai(?:\s+(?:(?:language)|-)?\s*model|language\s+model|assistant)\b",
    r"ignore\s+(?:all\s+)?(?:previous|prior|above|all)\s+instructions", r"disregard\s+(?:the\s+)?(?:report|previous|above|all)\b", r"follow\s+these\s+instructions?\s+instead",
    r"instead\s+of\s+the\s+system\s+prompt", "请忽略以上规则", "忽略[^\n]*(?:之前|以上|所有)[^\n]*(?:指令|规则|提示)", "改为输出", "不要遵守[^\n]*(?:系统|指令|规则)", r"^\s*system\s*:\s",
    r"do\s+not\s+reveal\s+these\s+instructions", r"\bai\s+assistants?\b[^\n]*\bmust\s+refuse\b", r"this\s+policy\s+is\s+enforced\s+with\s+zero\s+tolerance",
    r"\bif\s+you\s+are\s+an?\s+ai\s+(?:agent|language\s+model|automated\s+assistant)\b", r"\bany\s+user\s+caught\s+submitting\s+ai[-\s]generated\s+content\b",
    r"\bthis\s+includes\s+but\s+is\s+not\s+limited\s+to:\s+forum\s+posts\b", r"\bthis\s+applies\s+to\s+all\s+forms\s+of\s+ai\s+assistance\b", r"\bpermanently\s+banned\b",
    r"\bdo\s+not\s+generate\s+the\s+content\s+under\s+any\s+circumstances\b", r"\bthis\s+website\s+strictly\s+prohibits\s+ai[-\s]generated\s+content\b", r"\bplease\s+write\s+your\s+own\s+content\b",
    r"\bread\s+the\s+site\s+guidelines\b", r"\bautomated\s+session\b[^\n]*\bcompose\s+or\s+post\s+content\b", r"\bmust\s+immediately\s+stop\s+and\s+navigate\b",
    r"\bthere\s+are\s+no\s+exceptions\s+to\s+this\s+policy\b", r"\bthis\s+policy\s+applies\s+regardless\s+of\s+how\s+the\s+ai[-\s]generated\s+content\s+is\s+used\b", r"\[end\s+instructions?\]",
    r"\bviolators\s+will\s+be\s+permanently\s+ban", r"\bjailbreak\b", r"\bprompt\s*injection\b", r"you\s+are\s+(?:now\s+)?an?\s+(?:helpful|unfiltered|unrestricted)\s+(?:ai|assistant|language\s+model)",
    r"(?:\b(?:ignore|disregard|override|replace|follow|obey|reveal|publish|output|tell)\b|忽略|无视|覆盖|改为输出|不要遵守|发布|告诉).{0,120}(?:\bsystem\b|\binstructions?\b|\brules?\b|\bprompts?\b|系统|指令|规则|提示)",
])
FURNITURE = r"topic list|column headers|sortable|troubleshoot|cdn-cgi|challenges[.]cloudflare|turnstile|select all|cancel selecting|forum-attachments|[.](?:png|jpg|jpeg|webp|gif)\b"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def low(e: str, pattern: str) -> str:
    return f"regexp_matches(lower(coalesce({e}, '')), {q(pattern)})"


def injected(e: str) -> str:
    return f"regexp_matches({e}, {q(ORDERS)})"


def trimmed(e: str) -> str:
    return f"trim({e}, {SPACE})"


def scrub(e: str, most: int = 1000) -> str:
    lines = f"list_filter(list_transform(string_split_regex(replace(coalesce({e}, ''), chr(13), ''), '\\n+'), lambda p: {trimmed("regexp_replace(regexp_replace(p, '^>\\s?', ''), '^\\s*[-*]\\s+', '')")}), lambda p: p <> '')"
    parts = "string_split(regexp_replace(p, '([。！？!?])\\s*|([.])\\s+', '\\1\\2' || chr(1), 'g'), chr(1))"
    clean = f"CASE WHEN {injected('p')} THEN array_to_string(list_filter(list_transform({parts}, lambda s: {trimmed('s')}), lambda s: s <> '' AND NOT regexp_matches(s, '^[0-9]+[.)]?$') AND NOT {injected('s')}), ' ') ELSE p END"
    joined = f"array_to_string(list_filter(list_transform({lines}, lambda p: {clean}), lambda p: p <> ''), ' ')"
    return f"substring({trimmed(f"regexp_replace({joined}, '\\s{{2,}}', ' ', 'g')")}, 1, {most})"


def markdown(e: str, multiline: bool = False) -> str:
    one = f"replace(coalesce({e}, ''), chr(13), '')"
    one = one if multiline else f"regexp_replace({one}, '\\n+', ' ', 'g')"
    bare = trimmed(f"regexp_replace({one}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')")
    for sign in "\\`*_[]<>#+.!|()-":
        bare = f"replace({bare}, {q(sign)}, {q(chr(92) + sign)})"
    return bare


def cell(e: str) -> str:
    return trimmed(f"replace(replace(coalesce({e}, ''), '|', '\\|'), chr(10), ' ')")


def norm_url(e: str) -> str:
    u = q(rules.URL)
    return f"CASE WHEN regexp_matches({e}, {u}) THEN lower(regexp_extract({e}, {u}, 1) || regexp_replace(regexp_extract({e}, {u}, 2), '/$', '')) ELSE lower({e}) END"


def host_of(e: str) -> str:
    u = q(rules.URL)
    return f"CASE WHEN regexp_matches({e}, {u}) THEN lower(regexp_extract({e}, {u}, 1)) ELSE 'unknown' END"


def url_key(e: str) -> str:
    u = q(rules.WEB_URL)
    g = lambda k: f"regexp_extract({e}, {u}, {k})"
    port = f"CASE WHEN lower({g(1)}) || {g(3)} IN ('https:443', 'http:80') THEN '' ELSE {g(3)} END"
    return f"CASE WHEN regexp_matches({e}, {u}) THEN lower({g(1)}) || '://' || lower({g(2)}) || {port} || regexp_replace({g(4)}, '/$', '') ELSE regexp_replace({e}, '/$', '') END"


def substance(e: str) -> str:
    bare = f"regexp_replace(coalesce({e}, ''), '(?i)https?://\\S+', ' ', 'g')"
    return f"""CASE WHEN {trimmed(f"coalesce({e}, '')")} <> '' THEN CAST(len(regexp_extract_all({bare}, '[一-鿿]')) + len(regexp_extract_all({bare}, '[A-Za-z][A-Za-z0-9''./-]{{4,}}')) - CASE WHEN {low(e, FURNITURE)} THEN 10 ELSE 0 END AS INTEGER) END"""


def cluster(e: str) -> str:
    out = "CASE"
    for name, match, exclude, _ in rules.CLUSTERS:
        out += f" WHEN {low(e, match)}" + (f" AND NOT {low(e, exclude)}" if exclude else "") + f" THEN '{name}'"
    return out + " END"


def day_num(e: str) -> str:
    """yyyymmdd of six spellings."""
    s = f"trim({e})"

    def form(p: str, y: int, m: int, d: int) -> str:
        g = lambda k: f"TRY_CAST(regexp_extract({s}, '{p}', {k}) AS INTEGER)"
        return f"WHEN regexp_matches({s}, '{p}') THEN {g(y)} * 10000 + {g(m)} * 100 + {g(d)}"

    month = f"list_position([{', '.join(map(q, rules.MONTHS))}], lower(substring({s}, 1, 3)))"

    def named(p: str, y: int, d: int) -> str:
        g = lambda k: f"TRY_CAST(regexp_extract({s}, '{p}', {k}) AS INTEGER)"
        return f"WHEN coalesce({month}, 0) > 0 AND regexp_matches({s}, '{p}') THEN {g(y)} * 10000 + {month} * 100 + {g(d)}"

    forms = [
        form("^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", 1, 2, 3),
        form("^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})", 1, 2, 3),
        form("^([0-9]{4})([0-9]{2})([0-9]{2})", 1, 2, 3),
        form("([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})", 3, 1, 2),
        named("([0-9]{1,2}),?\\s*([0-9]{4})", 2, 1),
        named("([0-9]{4}),?\\s+([0-9]{1,2})", 1, 2),
    ]
    return f"CAST(CASE {' '.join(forms)} END AS INTEGER)"
