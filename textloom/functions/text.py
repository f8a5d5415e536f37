"""Column functions on text: normalization, tokenizers, shingles, cleaning, flags.

Patterns are Java's, kept to what RE2 has too where a query is checked in SQL.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
WORD = r"[A-Za-z_][A-Za-z_0-9$]*|[0-9]+(?:\.[0-9]+)*|[\p{L}\p{N}_]+"
LEXICAL = r"[A-Za-z_][A-Za-z_0-9$]*|[0-9]+(?:\.[0-9]+)*|[^\s]"
SQL_TOKEN = (
    r"(?s)(?:--[^\r\n]*|/\*.*?\*/)|(?:'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`[^`]*`)|(?:->>|->|::|<=|>=|<>|!=|:=|=>|\|\||&&)|"
    r"(?:\$[A-Za-z_][A-Za-z0-9_$]*|\$[0-9]+|:[A-Za-z_][A-Za-z0-9_$]*|@[A-Za-z_][A-Za-z0-9_$]*)|(?:[0-9]+(?:\.[0-9]+)+)|"
    r"(?:[A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z_][A-Za-z0-9_$]*)+)|(?:[A-Za-z_][A-Za-z0-9_$]*)|(?:[0-9]+(?:\.[0-9]+)?)|(?:[+\-*/%<>=~!&|^(),.;\[\]{}])"
)
FIELD_TOKEN = (
    r"(?i)->>|->|::|<=|>=|<>|!=|:=|=>|\|\||&&|[0-9]+(?:\.[0-9]+)+|[0-9]+[A-Za-z][A-Za-z0-9_]*|"
    r"[A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z_][A-Za-z0-9_$]*)+|[A-Za-z_][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?"
)
POOL_TOKEN = r"[A-Za-z][A-Za-z0-9_]+|[0-9]+(?:\.[0-9]+)*"
SET_TOKEN = r"[a-z0-9_]+"
#: What Spark is given for these: the same matches. The first sign decides what is tried, and no round of a group is taken
#: back, as Java remembers those on the stack, which a long text after a single quote, or a long run of 1.1.1, overflows. A
#: quote that is never closed ends, as in the original, at the first sign of its last pair, if it has one.
_NAME, _NUMBER = r"[A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z_][A-Za-z0-9_$]*+)*+", r"[0-9]++(?:\.[0-9]++)*+"
_OPERATOR = r"->>|->|::|<=|>=|<>|!=|:=|=>|\|\||&&"
_SINGLE = r"'(?:[^']++|'')*+'|'.*'(?='[^']*+\z)"
_DOUBLE = _SINGLE.replace("'", '"')
SAME = {
    WORD: rf"[A-Za-z_][A-Za-z_0-9$]*|{_NUMBER}|[\p{{L}}\p{{N}}_]+",
    LEXICAL: rf"[A-Za-z_][A-Za-z_0-9$]*|{_NUMBER}|[^\s]",
    SQL_TOKEN: rf"(?s){_NAME}|{_NUMBER}|(?=[$@:'\"`+\-*/%<>=~!&|^(),.;\[\]{{}}])(?:--[^\r\n]*+|/\*.*?\*/|{_SINGLE}|{_DOUBLE}|`[^`]*+`|{_OPERATOR}|"
    r"\$[A-Za-z_][A-Za-z0-9_$]*+|\$[0-9]++|[:@][A-Za-z_][A-Za-z0-9_$]*+|[+\-*/%<>=~!&|^(),.;\[\]{}])",
    POOL_TOKEN: rf"[A-Za-z][A-Za-z0-9_]+|{_NUMBER}",
    FIELD_TOKEN: rf"{_NAME}|[0-9]++(?:(?:\.[0-9]++)++|[A-Za-z][A-Za-z0-9_]*+|)|(?=[\-:<>!=|&])(?:{_OPERATOR})",
}
POOL_STOPWORDS = (
    "a an and are as at be because by can could do does for from has have how i if in into is it my of on or our should so that the "
    "their then this to using was we what when where which why will with would query sql database table postgresql postgres mysql sqlite "
    "mariadb duckdb select insert update delete create alter drop join group order having null true false error"
).split()
FIELD_STOPWORDS = (
    "a an the is are was were be been being of to in for on with as at by from and or but if then than this that these those it its how "
    "what why which who where when should would can could may might must do does did not no without into about after before around "
    "between under over question sql dialect version observed error behavior message code state"
).split()
FIELD_SQL_KEYWORDS = (
    "select from where insert into values update set delete create table alter drop with as join inner outer left right full on group by "
    "order having limit offset distinct union all null true false and or not case when then else end cast"
).split()
BOILERPLATE = (
    "home", "menu", "about", "documentation", "docs", "download", "license", "support", "purchase", "search", "skip to main content",
    "skip navigation", "previous next", "previous page next page", "edit this page", "on this page", "table of contents",
    "accept all cookies", "cookie settings", "back to top",
)
BOILERPLATE_LINE = r"^(?:(?:home\s*[›»/]\s*)?(?:documentation|docs)\s*[›»/]\s*|(?:previous|next|up|home)(?:\s+(?:previous|next|up|home))*)$"
LIST_MARK = r"^(?:[-*+]\s+|[0-9]+[.)]\s+)"
#: All begin at a word's start with a letter or digit, which is asked once, not by each of them.
ERROR_TOKEN = r"(?i)\b(?=[0-9A-Z])(?:(?:SQLSTATE\s*[=:]?\s*)?[0-9A-Z]{5}\b|(?:ER_|SQLITE_)[A-Z0-9_]+\b|ERROR\s+[0-9]{3,5}\b)"
SQL_START = (
    r"(?im)```\s*(?:sql|postgresql|mysql|sqlite|mariadb|duckdb)\b\s*\n\s*\S|^\s*(?:mysql>|sqlite>|postgres(?:ql)?[=#>]|"
    r"(?:SELECT|INSERT|UPDATE|DELETE|MERGE|CREATE|ALTER|DROP|WITH|PRAGMA|EXPLAIN|VACUUM)\b)|^\s*(?:Syntax|Synopsis)\s*:\s*$"
)
_NUMBERED_ERROR = r"(?i)\b(?:ERROR\s+[0-9]{3,5}|(?:OBSOLETE_)?ER_[A-Z0-9_]+|SQLSTATE\s*\[?[0-9A-Z]{5}\]?)\b"
ERROR_OF = {
    "postgresql": r"(?i)\bSQLSTATE\s*[=:]?\s*[0-9A-Z]{5}\b|\b(?:ERROR|FATAL|PANIC):",
    "mysql": _NUMBERED_ERROR,
    "sqlite": r"(?i)\bSQLITE_[A-Z0-9_]+\b|\b(?:error|extended error) code\b",
    "mariadb": _NUMBERED_ERROR,
    "duckdb": r"(?i)\b(?:Binder|Catalog|Conversion|Invalid Input|Parser|Transaction) Error\b",
}
GENERIC_ERROR = r"(?i)\b(?:error code|error message|SQLSTATE)\b"
VERSION_TALK = (
    r"(?i)\b(?:version|release|deprecated|deprecation|compatib(?:le|ility)|incompatib(?:le|ility)|migration|upgrade|legacy|prior to|"
    r"before version|since version|new in|removed in|not supported)\b"
)
TOPICS = (
    ("errors", r"(?i)\b(?:error|sqlstate|diagnostic|exception|warning)\b"),
    ("migration", r"(?i)\b(?:migration|migrating|upgrade|compatib|deprecated|porting)\b"),
    ("functions", r"(?i)\b(?:function|aggregate|window function|scalar function|operator)\b"),
    ("data_types", r"(?i)\b(?:data type|datatype|type conversion|cast|collation)\b"),
    ("syntax", r"(?i)\b(?:syntax|statement|command|query|expression|grammar)\b"),
    ("configuration", r"(?i)\b(?:configuration|setting|parameter|pragma|server option)\b"),
    ("transactions", r"(?i)\b(?:transaction|locking|concurrency|isolation|commit|rollback)\b"),
    ("release_notes", r"(?i)\b(?:release|changelog|what'?s new)\b"),
)
SECRETS = (
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{30,}\b"),
    ("openai_token", r"\bsk-(?:proj-)?[A-Za-z0-9_-]{20,}\b"),
    ("generic_bearer", r"(?i)\bBearer\s+[A-Za-z0-9._~-]{32,}\b"),
)
MOJIBAKE = "(?:Ã[ -¿ƒ]|Â[\u0080-¿]|â€™|â€œ|â€\u009d|鈥.|聽|搂|锟斤拷)"
TRACKING_KEYS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"), ("\u00a0", " "), ("\u200b", ""))
#: In this order; "$1" stands for the group.
PROSE_RULES = (
    (r"(?s)<!--.*?-->", " "), (r"(?is)\{%\s*@marketo/form\b.*?%\}", " "), (r"\{%\s*(?:link|post_url)\s+([^%]+?)\s*%\}", "$1"),
    (r"(?i)\{%\s*hint\s+style=[\"']?(?:warning|danger)[\"']?\s*%\}", "Warning: "), (r"(?i)\{%\s*hint\s+style=[\"']?info[\"']?\s*%\}", "Note: "),
    (r"(?i)\{%\s*tab\s+title=[\"']([^\"']+)[\"']\s*%\}", "$1: "), (r"(?is)\{%\s*(?:end\w+|tabs|code|include)\b.*?%\}", " "),
    (r"\{\{\s*site\.[^}]+\}\}", " "), (r"(?i)_?\{This page is (?:licensed|Copyright):.*?\}\s*", " "), (r"</?[A-Za-z][^>]{0,200}>", " "),
    (r"[ \t\f\x0B]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
)
ATOMIC_SECTION = r"(?i)\b(?:syntax|synopsis|signature|parameters?|returns?|return value|description)\b"
FENCE_OPEN = r"(?im)```\s*(?:sql|postgresql|mysql|sqlite|mariadb|duckdb)\b"
SQL_LINE = r"(?im)^\s*(?:mysql>|sqlite>|postgres(?:ql)?[=#>]|(?:SELECT|INSERT|UPDATE|DELETE|MERGE|CREATE|ALTER|DROP|WITH|PRAGMA|EXPLAIN|VACUUM)\b)\s*\S+"
SYNTAX_BLOCK = r"(?im)^\s*(?:Syntax|Synopsis)\s*:\s*\n\s*\S+"
ERROR_EVIDENCE = (
    r"(?im)\b(?:SQLSTATE\s*[=:]?\s*[0-9A-Z]{5}|(?:OBSOLETE_)?ER_[A-Z0-9_]+|SQLITE_[A-Z0-9_]+|ERROR\s+[0-9]{3,5}|"
    r"(?:Binder|Catalog|Conversion|Invalid Input|Parser|Transaction) Error)\b|\berror message\b|^\s*(?:Error symbol|Error number|Message)\s*:"
)
TABLE_BLOCK = r"(?m)^\s*Table:\s*$\n\s*-\s*\S+"
SENTENCE_END = r"(?<=[.!?。！？])\s+(?=[A-Z0-9`\[])|\n{2,}"


def all_of(text: Column, pattern: str) -> Column:
    """Every match of the whole pattern, in order; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(SAME.get(pattern, pattern)), F.lit(0)), F.array().cast("array<string>"))


def _replaced(text: Column, parts: list[str], pattern: str, by: str) -> Column:
    """regexp_replace of a pattern whose matches hold one of the parts: texts without them, which are most, are not searched
    for it sign by sign. The text is bound to a lambda's variable, so that it is made once."""
    return F.element_at(F.transform(F.array(text), lambda t: F.when(reduce(or_, [F.contains(t, F.lit(x)) for x in parts]), F.regexp_replace(t, pattern, by)).otherwise(t)), 1)


def normalize_for_hash(text: Column) -> Column:
    """Line ends to LF, blanks run together, three or more line feeds to two, trimmed, lower case."""
    text = _replaced(text, ["\r"], r"\r\n?", "\n")
    text = _replaced(_replaced(text, ["  ", "\t"], r"[ \t]{2,}|\t", " "), ["\n\n\n"], r"\n{3,}", "\n\n")  # single blanks, which are most, stay as they are
    return F.lower(F.btrim(text, F.lit(" \t\n\x0b\f\r")))


def word_tokens(text: Column) -> Column:
    return all_of(text, WORD)


def word_count(text: Column) -> Column:
    return F.size(word_tokens(text)).cast("long")


def lexical_tokens(text: Column) -> Column:
    return all_of(text, LEXICAL)


def _lines(text: Column) -> Column:
    return _replaced(text, ["\r"], r"\r\n?", "\n")


def sql_tokens(text: Column) -> Column:
    """Comments, quoted strings, operators, parameters, versions, qualified names, words, numbers, signs; lower case."""
    return F.transform(all_of(_lines(text), SQL_TOKEN), F.lower)


def field_tokens(text: Column) -> Column:
    return F.transform(all_of(_lines(text), FIELD_TOKEN), F.lower)


def pool_tokens(text: Column, content_only: bool = False) -> Column:
    found = F.transform(all_of(text, POOL_TOKEN), F.lower)
    if content_only:
        found = F.filter(without(found, POOL_STOPWORDS), lambda t: F.length(t) > 2)
    return found


def set_tokens(text: Column) -> Column:
    return F.array_distinct(all_of(F.lower(text), SET_TOKEN))


def without(tokens: Column, words: list[str]) -> Column:
    """The tokens that are none of the words, repeats kept."""
    return F.filter(tokens, lambda t: ~t.isin(*words))


def shingles(tokens: Column, size: int = 5) -> Column:
    """Distinct runs of so many tokens; of fewer tokens, the distinct tokens."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.array_distinct(F.when(F.size(tokens) < size, tokens).otherwise(runs))


def ngrams(tokens: Column, size: int) -> Column:
    """Distinct runs of so many tokens; of fewer tokens, none."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.array_distinct(F.when(F.size(tokens) < size, F.array().cast("array<string>")).otherwise(runs))


def ngram_hashes(tokens: Column, size: int) -> Column:
    """ngrams as 64-bit hashes of the tokens' hashes: no run is spelled out."""

    def runs(hashes: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(hashes) - size + 1), lambda i: F.xxhash64(F.slice(hashes, i, size)))
        return F.array_distinct(F.when(F.size(hashes) < size, F.array().cast("array<bigint>")).otherwise(made))

    return F.element_at(F.transform(F.array(F.transform(tokens, lambda t: F.xxhash64(t))), runs), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def error_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(F.array_distinct(all_of(text, ERROR_TOKEN)), lambda t: F.replace(F.upper(t), F.lit(" "), F.lit(""))))


def is_boilerplate(text: Column) -> Column:
    line = F.regexp_replace(normalize_for_hash(text), LIST_MARK, "")
    return line.isin(*BOILERPLATE) | line.rlike(BOILERPLATE_LINE)


def is_navigation_table(text: Column) -> Column:
    norm = normalize_for_hash(text)
    few = F.size(F.filter(F.split(norm, "\n"), lambda x: F.trim(x) != "")) <= 6
    for term in ("prev", "up", "home", "next"):
        few = few & norm.rlike(rf"\b{term}\b")
    return few


def contains_sql(text: Column) -> Column:
    return text.rlike(SQL_START)


def contains_error_code(text: Column, dialect: Column) -> Column:
    found = text.rlike(GENERIC_ERROR)
    for name, pattern in ERROR_OF.items():
        found = found | ((dialect == name) & text.rlike(pattern))
    return found


def contains_version_talk(text: Column) -> Column:
    return text.rlike(VERSION_TALK)


def topic(section: Column, text: Column, source_type: Column) -> Column:
    sample = F.concat(F.coalesce(section, F.lit("")), F.lit("\n"), F.substring(text, 1, 1000))
    found = F.when(source_type == "release_notes", "release_notes")
    for name, pattern in TOPICS:
        found = found.when(sample.rlike(pattern), name)
    return found.otherwise("general")


def secrets(text: Column) -> Column:
    """Every match of the secret patterns: array of (type, line)."""

    def of(name: str, pattern: str) -> Column:
        # what is before the n-th match decides its line; splitting at the matches gives what lies between them
        parts = F.split(text, pattern, -1)
        line = lambda i: F.size(F.split(F.array_join(F.slice(parts, 1, i), ""), "\n", -1))
        at = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(name).alias("type"), line(i).alias("line")))

    return F.concat(*[of(*x) for x in SECRETS])


def is_damaged(text: Column) -> Column:
    return text.contains("�") | text.rlike(MOJIBAKE)


def is_valid_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, slashes of the path run together, tracking keys dropped, the query sorted, no fragment."""
    url = F.regexp_replace(F.trim(url), r"#.*$", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), r"/{2,}", "/")
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~F.lower(F.substring_index(x, "=", 1)).isin(*TRACKING_KEYS))
    query = F.array_join(F.array_sort(F.transform(pairs, lambda x: F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))))), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def slug(value: Column, length: int = 70) -> Column:
    made = F.lower(F.regexp_replace(F.regexp_replace(value, r"[^a-zA-Z0-9._-]+", "-"), r"^[-._]+|[-._]+$", ""))
    return F.substring(F.when(made == "", "document").otherwise(made), 1, length)


def clean_prose(text: Column) -> Column:
    """Entities of markup, comments, template tags and markup fragments out; blanks run together; trimmed."""
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    for pattern, sign in PROSE_RULES:
        text = F.regexp_replace(text, pattern, sign)
    return text


def clean_atomic(text: Column) -> Column:
    """Code and tables: line ends and trailing blanks only, empty lines at either end dropped."""
    text = F.replace(_lines(text), F.lit("​"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t\f\x0B]+$", ""), r"^(?:[ \t]*\n)+|\n+$", "")


def chunk_body(text: Column) -> Column:
    """What follows the first empty line, or all of it."""
    return F.when(text.contains("\n\n"), F.regexp_replace(text, r"(?s)^.*?\n\n", "")).otherwise(text)


def excerpt(text: Column, length: int = 280) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > length, F.concat(F.rtrim(F.substring(flat, 1, length - 1)), F.lit("…"))).otherwise(flat)


def alnum_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(text), F.lit(1))


def fences_balanced(text: Column) -> Column:
    return (F.size(F.split(text, "```", -1)) - 1) % 2 == 0


def is_usable_fragment(text: Column, section: Column, has_error: Column) -> Column:
    """Whether a short passage stands by itself: an error record, SQL, code, a table or a signature, with fences closed."""
    marked = has_error & text.rlike(ERROR_EVIDENCE) | text.rlike(SQL_LINE) | text.rlike(SYNTAX_BLOCK) | text.contains("```") | text.rlike(TABLE_BLOCK)
    return fences_balanced(text) & (marked | section.rlike(ATOMIC_SECTION) & (word_count(text) >= 8))


def material_kept(text: Column, has_error: Column) -> Column:
    """(applicable, kept): whether a passage holds SQL or an error record, and whether that is whole."""
    sql = text.rlike(FENCE_OPEN) | text.rlike(SQL_LINE) | text.rlike(SYNTAX_BLOCK)
    whole = fences_balanced(text) & (~has_error | text.rlike(ERROR_EVIDENCE))
    return F.struct((sql | has_error).alias("applicable"), (~(sql | has_error) | whole).alias("kept"))


def rendered(title: Column, section: Column, body: Column) -> Column:
    """A passage under its title, and its section where that is another."""
    head = F.concat(F.lit("Title: "), title, F.when(F.coalesce((section != "") & (section != title), F.lit(False)), F.concat(F.lit("\nSection: "), section)).otherwise(""))
    return F.concat(head, F.lit("\n\n"), F.regexp_replace(body, r"^\s+|\s+$", ""))
