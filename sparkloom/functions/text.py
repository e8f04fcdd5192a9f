"""Text functions as column expressions: tokens, hashes, budgets, labels and normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, thresholds and patterns that results depend on.
SPARSE_STOP_WORDS = """
a an the and or but in on at to for of with is are was were be been being have has had do does did will would could
should may might shall can need that this these those it its i you he she we they their what which who how when where
not no so if as by from up about into than then also just more
""".split()
QUERY_STOP_WORDS = """
як що чому коли де без на у в з для про це та і або але якщо то не по до від при
how what why when where without with in on for to the a an of and or but if is are was be by at from not no it its as
this that
""".split()
FOLLOW_UP_WORDS = """
it this that these those they them he she him her its their
він вона воно вони це цей ця ці той та ті його її їх їм
""".split()
SPARSE_BUCKETS = 1 << 20
ACTIVATION = r"(?i)увімкнути|\benable\b|\bactivate\b|without ollama|без ollama"
PROVIDER = r"(?i:bge-m3-onnx)|ONNX_EMBED|(?i:\bprovider\b)|(?i:провайдер)"
NAVIGATION = r"(?i)де знаходиться|location in source|\bsource\b|експортує|\bexports\b|entry point|which file|where is"
EXACT_TOKEN = r"[A-Z][A-Z_]{2,}[A-Z0-9]|[a-z][A-Za-z]{2,}[A-Z][A-Za-z]*|src/|\.js\b|\.md\b|@\d+"
CONFIG_ENV = r"(?i)\benv\b|environment variable|config\.json|\bprovider\b|провайдер"
CONFIG_WORDS = """
qdrant_url qdrant_key dense_provider sparse_provider onnx_embed rerank_enabled rerank_model link_enabled max_chunk_tokens
min_chunk_tokens source_root collection context_model bench_provider env environment config.json configuration змінні середовища
""".split()
PREAMBLE = (
    r"(?i)^(okay|ok[,!\s]|sure|certainly|of course|great[,!]|here[‘’]?s\b|here is\b|let me\b|let[‘’]?s\b|i[‘’]?ll\b|i can\b|as an ai|ось |звичайно|гаразд[,!]|давай)"
)
SUMMARY_TIERS = (300, 1500)
LENGTH_BUCKETS = (16, 32, 64, 128, 256)


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_runs(text: Column, size: int, inner: bool = False) -> Column:
    """array<string>: the distinct runs of ``size`` words of a text, between white space; ``inner``: without its first
    and last word, which may be parts of words. Empty where there are too few."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        n = F.size(w) - size + 1
        low, high = (2, n - 1) if inner else (1, n)
        return F.when(high >= low, F.array_distinct(F.transform(F.sequence(F.lit(low), high), lambda i: F.array_join(F.slice(w, i, size), " ")))).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def _words(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def sparse_words(text: Column) -> Column:
    """Lower case, other than letters, digits and space as spaces, split into words."""
    return F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+")


def sparse_tokens(text: Column) -> Column:
    """The words of two characters or more that are no stop words."""
    return F.filter(sparse_words(text), lambda t: (F.length(t) > 1) & ~F.array_contains(_words(SPARSE_STOP_WORDS), t))


def is_technical(token: Column) -> Column:
    return token.contains("_") | token.rlike("[A-Z]{2,}") | token.rlike("[a-z][A-Z]") | (F.length(token) >= 8)


def query_tokens(text: Column) -> Column:
    """map<string, boolean>: each lower-cased word that is no stop word, and whether its last occurrence looks
    technical."""
    raw = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0), lambda t: ~F.array_contains(_words(QUERY_STOP_WORDS), F.lower(t)))
    # sorted by word, the last occurrence first: what follows an equal word goes
    placed = F.array_sort(F.transform(raw, lambda t, i: F.struct(F.lower(t).alias("w"), (-i).alias("i"), is_technical(t).alias("t"))))
    last = bound(placed, lambda p: F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["w"] != x["w"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["w"], x["t"])))


def guard_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_@.]+"), 0)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


def hash_bucket(token: Column) -> Column:
    """djb2 over UTF-16 code units in 32 bits, folded to 2**20 buckets; a character beyond U+FFFF is two units."""
    unit = lambda a, c: F.shiftright(F.shiftleft(a * 33, 32), 32).bitwiseXOR(c)
    high, low = (lambda c: F.shiftright(c - 0x10000, 10) + 0xD800), (lambda c: (c - 0x10000).bitwiseAND(0x3FF) + 0xDC00)
    step = lambda a, c: F.when(c > 0xFFFF, unit(unit(a, high(c)), low(c))).otherwise(unit(a, c))
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.abs(F.aggregate(codes, F.lit(5381).cast("bigint"), step)) % SPARSE_BUCKETS


def utf16_length(text: Column) -> Column:
    """How many UTF-16 code units a text has: a character beyond U+FFFF counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def left_units(text: Column, most: int) -> Column:
    """The first ``most`` UTF-16 code units; a character of which only a half would fit is left out."""
    raw = F.encode(text, "UTF-16BE")
    halved = F.hex(F.substring(raw, 2 * most - 1, 1)).between("D8", "DB")
    cut = F.decode(F.substring(raw, F.lit(1), F.when(halved, 2 * most - 2).otherwise(2 * most)), "UTF-16BE")
    return F.when(F.length(text) * 2 <= most, text).when(utf16_length(text) == F.length(text), F.substring(text, 1, most)).otherwise(cut)


def heuristic_tokens(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4)


def script_tokens(text: Column) -> Column:
    """Four characters a token, down to two as the share of Cyrillic rises."""
    n = F.length(text)
    share = F.length(F.regexp_replace(text, "[^\u0400-\u04ff]", "")) / n
    return F.when(n == 0, F.lit(0)).otherwise(F.ceil(n / (4 - 2 * share))).cast("bigint")


def last_tokens(text: Column, most: int) -> Column:
    """The longest suffix of at most ``most`` heuristic tokens."""
    return F.when(F.length(text) <= 4 * most, text).otherwise(F.substring(text, -4 * most, 4 * most))


def safe_last_tokens(text: Column, most: int) -> Column:
    """The same, moved forward to the next white space where it would cut a word; empty if there is none."""
    cut = last_tokens(text, most)
    at_word = F.substring(text, F.length(text) - 4 * most, F.lit(1)).rlike(r"^\s$") | F.substring(cut, 1, 1).rlike(r"^\s$")
    return F.when(F.length(text) <= 4 * most, text).when(at_word, F.ltrim(cut)).otherwise(F.regexp_extract(cut, r"\s+([\s\S]*)$", 1))


def truncate_to_budget(text: Column, most: int) -> Column:
    return left_units(text, 4 * most)


def sentences(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?\n]+|[^.!?\n]+$"), 0), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    found = F.filter(found, lambda x: x != "")
    return F.when(F.size(found) == 0, F.array(text)).otherwise(found)


def canonical_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\s+", " "))


def strip_page_markers(text: Column) -> Column:
    """Text without the page marks ``-- 3 of 9 --`` of a converted page file, wherever they stand."""
    return F.regexp_replace(text, r"--\s*\d+\s*of\s*\d+\s*--", "")


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", F.lit("section")).otherwise(F.substring(dashed, 1, 60))


def wikilinks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), 1)


def frontmatter_value(value: Column) -> Column:
    """A ``k: v`` value as an array, split at commas."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def frontmatter(text: Column) -> Column:
    """map<string, array<string>> of the ``k: v`` lines between the text's first two ``---`` lines; values are split
    at commas, brackets and quotes around them go. Of a repeated key the last counts; empty without front matter."""
    body = F.regexp_extract(F.regexp_replace(text, r"\r\n?", "\n"), r"^---\n([\s\S]*?)\n---(?:\n|$)", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^[\w-]+:"))
    bare = lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), r"^\[|\]$", ""), r"[\"']", "")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("k"), frontmatter_value(bare(F.regexp_extract(x, r"^[\w-]+:(.*)$", 1))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def normalize_tag(tag: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(tag)), r"\s+", "-")


def normalize_tags(tags: Column, low: int = 2, high: int = 39) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, normalize_tag), lambda t: (F.length(t) >= low) & (F.length(t) <= high)))


def combined_tags(tags: Column) -> Column:
    """Tags of the combined prompt: 2 to 40 characters."""
    return normalize_tags(tags, 2, 40)


def listed_tags(raw: Column, most: int = 6) -> Column:
    """Tags of a model that answers in lines or with commas: bullets and numbers go, then all but ``a-z``, ``0-9``
    and ``-``; the first ``most`` distinct ones."""
    parts = F.transform(F.split(F.lower(raw), r"[,\n]"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*•\d.)]+", "")))
    clean = F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s+", "-"), "[^a-z0-9-]", ""), "^-+|-+$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda x: (F.length(x) >= 2) & (F.length(x) <= 39))), 1, most)


def merge_tags(existing: Column, generated: Column) -> Column:
    return F.array_distinct(F.concat(existing, generated))


def sanitize_summary(raw: Column, most: int = 600) -> Column:
    """A summary without label and quotes, or null where it is a preamble, markup, too short or long, or
    repeats itself."""
    s = F.regexp_replace(F.trim(raw), r"(?i)^summary\s*:\s*", "")
    s = F.trim(F.regexp_replace(s, "^[\"'«]+|[\"'»]+$", ""))
    flat = F.trim(F.regexp_replace(s, r"\s+", " "))
    words = F.split(F.lower(flat), " ")
    dull = (F.size(words) >= 25) & (F.size(F.array_distinct(words)) / F.size(words) < 0.4)
    bad = s.rlike(PREAMBLE) | s.rlike(r"(?m)^#{1,6}\s|\*\*|^\s*[-*>]\s") | (F.length(flat) < 20) | (F.length(flat) > most) | dull
    return F.when(~bad, flat)


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\b((?:api[-_]?key|token|secret|password)\s*[=:]\s*)\S+", "$1[redacted]")


#: scheme, user info, host and port of a url; a host has no white space, quotes or brackets.
_ORIGIN = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#\\]*@)?([^\s/?#\\@\"'<>^`{|}:]+|\[[0-9A-Fa-f:.]+\])(?::(\d{0,5}))?(?=[/?#\\]|\s*$)"
_DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def redact_url(url: Column) -> Column:
    """``scheme://host[:port]`` of a url, without user, password, path, query and fragment; a default port goes.
    ``(not set)`` for null or empty, ``(invalid URL)`` where there is no scheme or host."""
    scheme, host, port = F.lower(F.regexp_extract(url, _ORIGIN, 1)), F.lower(F.regexp_extract(url, _ORIGIN, 2)), F.regexp_extract(url, _ORIGIN, 3)
    usual = F.lit(False)
    for name, number in _DEFAULT_PORTS.items():
        usual = usual | ((scheme == name) & (port == number))
    shown = F.concat(scheme, F.lit("://"), host, F.when((port == "") | usual, "").otherwise(F.concat(F.lit(":"), port)))
    return F.when(F.coalesce(url, F.lit("")) == "", "(not set)").when(scheme == "", "(invalid URL)").otherwise(shown)


def redact_errors(message: Column, secrets: list[str | None] = ()) -> Column:
    """An error message without the given secrets, its http urls cut to scheme and host where they have user
    info, a query or a path; empty for null."""
    out = F.coalesce(message, F.lit(""))
    for x in secrets:
        if x:
            out = F.replace(out, F.lit(x), F.lit("[REDACTED]"))
    pieces = F.split(F.regexp_replace(out, r"(https?://[^\s\"')]+)", "\u0001$1\u0001"), "\u0001")
    bare = lambda u: F.regexp_extract(u, r"^https?://[^/?#@]+/?$", 0) == u
    shown = lambda u: F.when(u.rlike(r"^https?://") & ~bare(u) & (redact_url(u) != "(invalid URL)"), redact_url(u)).otherwise(u)
    return F.array_join(F.transform(pieces, shown), "")


def sanitize_header(text: Column) -> Column:
    return F.regexp_replace(text, "[\n\r\u2028\u2029]+", " ")


def compact_snippet(text: Column, most: int = 150) -> Column:
    return F.when(utf16_length(text) > most, F.concat(left_units(text, most), F.lit("..."))).otherwise(text)


def dir_prefix(path: Column, depth: int) -> Column:
    """The first ``depth`` folders with a closing slash; ``(root)`` for a bare file."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.when(F.size(folders) == 0, F.lit("(root)")).otherwise(F.concat(F.array_join(F.slice(folders, 1, depth), "/"), F.lit("/")))


def deterministic_context(source_file: Column, section: Column) -> Column:
    return F.array_join(F.filter(F.array(source_file, section), lambda x: x != ""), " › ")


def entity_context(heading_path: Column, label: Column, near: Column, most: int = 500) -> Column:
    """What an entity is embedded with: its heading path, a label, and the beginning of the prose beside it, without
    lines that are placeholders and with single spaces. Parts that are empty are left out."""
    lines = F.filter(F.split(F.trim(F.coalesce(near, F.lit(""))), "\n"), lambda x: ~F.trim(x).rlike(r"^\[[^\]]*node: "))
    prose = F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))
    parts = F.array(F.coalesce(heading_path, F.lit("")), F.coalesce(label, F.lit("")), F.left(prose, F.lit(most)))
    return F.array_join(F.filter(parts, lambda x: x != ""), " — ")


def _activation(text: Column, label: Column) -> Column:
    return (label == "provider-activation") | (text.rlike(ACTIVATION) & text.rlike(PROVIDER))


def _config_words(text: Column, label: Column) -> Column:
    out = label == "config-env"
    for word in CONFIG_WORDS:
        out = out | F.contains(F.lower(text), F.lit(word))
    return out


def classify_query(text: Column, label: Column | None = None, variant: str = "v3") -> Column:
    """A query's class by ordered rules; a label decides config-env and provider-activation where it is given.

    ``v1`` knows no config-env and reads no label; ``v2`` asks for config words first; ``v3`` asks for
    activation first and then for a few config patterns, ``v3-words`` for the config words of ``v2``.
    """
    label = F.coalesce(label, F.lit("")) if label is not None else F.lit("")
    activation, unlabelled = F.lit("provider-activation"), F.lit("")
    words, pattern = _config_words(text, label), (label == "config-env") | text.rlike(CONFIG_ENV)
    first = {
        "v1": [(_activation(text, unlabelled), activation)],
        "v2": [(words, F.lit("config-env")), (_activation(text, unlabelled), activation)],
        "v3": [(_activation(text, label), activation), (pattern, F.lit("config-env"))],
        "v3-words": [(_activation(text, label), activation), (words, F.lit("config-env"))],
    }[variant]
    out = F.when(text.rlike(NAVIGATION), "source-navigation").when(text.rlike(EXACT_TOKEN), "exact-token").otherwise("semantic")
    for test, name in reversed(first):
        out = F.when(test, name).otherwise(out)
    return out


def looks_like_follow_up(question: Column, has_context: Column, short: int = 12) -> Column:
    words = F.filter(F.split(question, r"\s+"), lambda w: w != "")
    first = F.regexp_replace(F.lower(F.get(words, F.lit(0))), r"[^\p{L}]", "")
    return has_context & ((F.size(words) < short) | F.coalesce(F.array_contains(_words(FOLLOW_UP_WORDS), first), F.lit(False)))


def empty_section(text: Column) -> Column:
    return text.rlike(r"^\(empty section: .+\)$")


def summary_tier(tokens: Column) -> Column:
    low, high = SUMMARY_TIERS
    return F.when(tokens < low, "short").when(tokens < high, "medium").otherwise("structured")


def length_bucket(n: Column) -> Column:
    """The least bound of LENGTH_BUCKETS that holds n; null beyond."""
    found = F.lit(None).cast("bigint")
    for bound in reversed(LENGTH_BUCKETS):
        found = F.when(n <= bound, F.lit(bound).cast("bigint")).otherwise(found)
    return found


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**`` over folders, ``*`` and ``?`` within one."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "/_-" else c)
            i += 1
    return f"^{out}$"


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a path is ignored: a pattern without ``/`` and ``*`` names a base name, any other is a glob over
    the path or its base name. Blank lines and ``#`` comments are no patterns."""
    base = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for p in (x.strip().rstrip("/") for x in patterns):
        if not p or p.startswith("#"):
            continue
        out = out | ((base == p) if "/" not in p and "*" not in p else path.rlike(glob_regex(p)) | base.rlike(glob_regex(p)))
    return out


# Frequent words by which a language is told.
LANGUAGE_WORDS = {
    "de": "der die das und ist nicht von ein eine mit zu den dem des",
    "en": "the and of to in is that for it with as was be on",
    "es": "el la los las que y en un una por con para del no",
    "fr": "le la les et des est que dans un une pour du qui pas",
}


# Frequent words of languages in Latin script, and scripts that stand for one language.
LATIN_WORDS = {
    "ces": "je že se na to jako jsou ale který nebo",
    "dan": "og er det ikke til som på af med har",
    "deu": "der die und das ist nicht ein mit den von",
    "eng": "the and of to in is that for with was",
    "fin": "ja on ei se että oli mutta kun niin hän",
    "fra": "le la les de des et est une que dans pour pas qui un",
    "hun": "az és hogy nem egy van meg ez mint csak",
    "ind": "yang dan di untuk dengan tidak ini dari adalah pada",
    "ita": "il la che di non una per sono con della gli",
    "nld": "de het een van en niet dat zijn voor met",
    "pol": "nie się jest że do jak ale lub oraz przez",
    "por": "não uma os para com de do da em que são mais",
    "ron": "și este nu care în cu pentru din sau mai",
    "spa": "el la los las de que y en por una con para del es",
    "swe": "och att det är inte som på för med har",
    "tur": "bir ve bu için ile çok değil olarak daha ne",
    "vie": "và của là không có được cho trong một các",
}
SCRIPTS = {
    "jpn": "[\\u3040-\\u30ff]",
    "kor": "[\\uac00-\\ud7af]",
    "cmn": "[\\u4e00-\\u9fff]",
    "ell": "[\\u0370-\\u03ff]",
    "heb": "[\\u0590-\\u05ff]",
    "arb": "[\\u0600-\\u06ff]",
    "hin": "[\\u0900-\\u097f]",
    "ukr": "[іїєґІЇЄҐ]",
    "rus": "[ыэъёЫЭЪЁ]",
}
SAMPLE, LEAST_SAMPLE, OWN_SCRIPT = 4000, 100, 0.01


def language_of(text: Column, forced: Column | None = None) -> Column:
    """The language of a text as a three-letter code, from a sample without code: that of a script or of letters which
    stand for one language, if a hundredth of the sample is in it, else that with the most frequent words; of equals
    the first by code. Null for a short text or one without any. ``forced``: what it is said to be, unless that is
    empty or ``auto``."""
    sample = F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"```[\s\S]*?```", " "), r"`[^`\n]*`", " "), 1, SAMPLE)

    def told(s: Column) -> Column:
        words = F.split(F.lower(s), r"[^\p{L}]+")
        by_word = bound(words, lambda w: F.array_min(F.array(*[F.struct((-F.size(F.filter(w, _is_word(v)))).alias("n"), F.lit(k).alias("lang")) for k, v in LATIN_WORDS.items()])))
        out = F.when(by_word["n"] < 0, by_word["lang"])
        for k, letters in reversed(SCRIPTS.items()):
            out = F.when(F.regexp_count(s, F.lit(letters)) >= OWN_SCRIPT * F.length(s), k).otherwise(out)
        return F.when(F.length(F.trim(s)) >= LEAST_SAMPLE, out)

    found = bound(sample, told)
    if forced is None:
        return found
    said = F.lower(F.trim(F.coalesce(forced, F.lit(""))))
    return F.when((said != "") & (said != "auto"), said).otherwise(found)


def _is_word(profile: str):
    return lambda w: F.array_contains(_words(profile.split()), w)


def language_hint(text: Column, least: int = 100) -> Column:
    """The language most of whose frequent words the text has; of equals the first by code; null for a text of
    fewer than ``least`` characters or without any."""
    words = F.split(F.lower(F.regexp_replace(text, r"```[\s\S]*?```", " ")), r"[^\p{L}]+")
    counts = F.array(*[F.struct((-F.size(F.filter(words, _is_word(v)))).alias("n"), F.lit(k).alias("lang")) for k, v in LANGUAGE_WORDS.items()])
    best = F.array_min(counts)
    return F.when((F.length(text) >= least) & (best["n"] < 0), best["lang"])


def parse_model_json(raw: Column, schema: str) -> Column:
    """The JSON in a model's answer: fences and what stands around the outermost braces or brackets go; null where
    it does not parse."""
    bare = F.regexp_replace(raw, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    body = F.coalesce(F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit("")), bare)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))
