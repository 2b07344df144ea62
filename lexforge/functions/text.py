"""Text scalars as column expressions: tokenizers, names, slugs, citations, code words.

Every function takes and returns columns and stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters that search folds, and the words that it leaves out.
SEARCH_ACCENTS = ("àâäéèêëîïôöùûüçñ", "aaaeeeeiioouuucn")
STOP_WORDS = (
    "a an the of to in on for and or is are was were be by with from at as it this that these those what who whom how when where which why can could should would do does did i we you my your our their there have has had not no "
    "le la les un une des du de et ou est sont etait en au aux pour par sur dans avec que qui quoi comment quand ou ce cet cette ces se sa son ses ne pas peut peuvent quel quelle quels quelles"
).split()
# Latin letters and their ASCII forms.
LATIN = {
    "a": "àáâãäåāăą", "c": "çćč", "d": "ďđ", "e": "èéêëēėęě", "g": "ğ", "i": "ìíîïīįı", "l": "ł", "n": "ñńň", "o": "òóôõöøōő",
    "r": "ř", "s": "śšşș", "t": "ťţț", "u": "ùúûüūůű", "y": "ýÿ", "z": "źżž",
}
LATIN_PAIRS = [("æ", "ae"), ("œ", "oe"), ("ß", "ss")]
# Words, verbs and endings that speak of code.
TECHNICAL_WORDS = (
    "controller controllers endpoint endpoints database sql json params callback callbacks middleware payload boolean nil null method methods function functions class classes "
    "redirect redirects redirected renders rendered partial http parameter parameters instance variable variables"
).split()
HTTP_VERBS = "GET POST PUT PATCH DELETE".split()
CODE_EXTENSIONS = ".rb .rs .js .ts .erb .yml .yaml .py .go .java .php".split()

_NOT_ALNUM = r"[^\p{L}\p{N}]+"
_HUMP = r"([\p{Ll}\p{N}])(\p{Lu})"


def _present(words: Column) -> Column:
    return F.filter(words, lambda w: w != "")


def search_tokens(text: Column) -> Column:
    """Terms of the search index: split at humps and punctuation, lower case, folded accents, one plural s off."""
    low = F.translate(F.lower(F.regexp_replace(text, _HUMP, "$1 $2")), *SEARCH_ACCENTS)
    return F.transform(_present(F.split(low, _NOT_ALNUM)), lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.left(w, F.length(w) - 1)).otherwise(w))


def stop_terms() -> list[str]:
    """The stop words in the form of the index's terms."""
    return sorted({w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in STOP_WORDS})


def is_stop(term: Column) -> Column:
    return term.isin(stop_terms())


def content_tokens(text: Column) -> Column:
    return F.filter(search_tokens(text), lambda w: ~is_stop(w))


def has_content_words(text: Column) -> Column:
    return F.exists(search_tokens(text), lambda w: ~is_stop(w))


def query_terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(content_tokens(text)))


def normalize_name(name: Column) -> Column:
    """One key for a name in any case, separators or number; the plural s goes when over three bytes are left."""
    low = F.lower(F.regexp_replace(name, _NOT_ALNUM, ""))
    return F.when(low.endswith("s") & (F.octet_length(low) > 4), F.left(low, F.length(low) - 1)).otherwise(low)


def identifier_words(name: Column) -> Column:
    return _present(F.split(F.lower(F.regexp_replace(name, _HUMP, "$1 $2")), _NOT_ALNUM))


def singular(w: Column) -> Column:
    """English singular of a lower-case word."""
    cut = lambda n: F.left(w, F.length(w) - n)
    es = None
    for end in ("tuses", "sses", "xes", "tches", "nches", "rches", "shes"):
        es = w.endswith(end) if es is None else es | w.endswith(end)
    return (
        F.when(w.endswith("ies") & (F.octet_length(w) > 4), F.concat(cut(3), F.lit("y")))
        .when(es, cut(2))
        .when(w.endswith("ss") | w.endswith("us") | w.endswith("is"), w)
        .when(w.endswith("s") & (F.octet_length(w) >= 4), cut(1))
        .otherwise(w)
    )


def file_name_words(name: Column) -> Column:
    low = F.lower(F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2"))
    return F.transform(_present(F.split(low, _NOT_ALNUM)), singular)


def statement_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), _NOT_ALNUM), lambda w: F.length(w) > 3))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold_latin(text: Column) -> Column:
    c = F.regexp_replace(F.lower(text), r"[̀-ͯ]", "")
    c = F.translate(c, "".join(LATIN.values()), "".join(k * len(v) for k, v in LATIN.items()))
    for a, b in LATIN_PAIRS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def slugify(text: Column) -> Column:
    slug = F.trim(F.regexp_replace(fold_latin(text), "[^a-z0-9]+", " "))
    return F.when(slug == "", F.lit("unnamed")).otherwise(F.replace(slug, F.lit(" "), F.lit("-")))


def cut_at_word(text: Column, n: int) -> Column:
    """At most n characters: before the last space within n - 1 of them, end punctuation off, an ellipsis on."""
    head = F.left(text, F.lit(n - 1))
    whole = F.when(F.instr(head, " ") > 0, F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(whole, "[,;: ]+$", ""), F.lit("…")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint(*parts: Column) -> Column:
    """Hash of parts with their bounds: each is closed by a NUL."""
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\0"))]), 256)


def code_identifiers(text: Column) -> Column:
    """Code words of prose, once each in order: in backticks, called, with an underscore or a hump."""
    words = F.regexp_extract_all(text, F.lit(r"`[^`]*`|[\p{L}\p{N}_]+\(?"), F.lit(0))
    inner = F.flatten(F.transform(words, lambda w: F.when(w.startswith("`"), F.transform(F.regexp_extract_all(w, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.concat(F.lit("("), x))).otherwise(F.array(w))))
    kept = F.filter(inner, lambda w: w.contains("(") | (w.contains("_") & w.rlike(r"\p{L}")) | w.rlike(r"\p{Ll}\p{Lu}"))
    return F.array_distinct(_present(F.transform(kept, lambda w: F.regexp_replace(w, r"^[(_]+|[(_]+$", ""))))


def code_leaks(text: Column, known: list[str]) -> Column:
    """Distinct lower-case tokens that speak of code; known names may look like classes."""
    strip = "[.,;:!?\"'()\\[\\]{}]+"

    def leak(raw: Column) -> Column:
        token = F.regexp_replace(raw, f"^{strip}|{strip}$", "")
        low = F.lower(token)
        ends = F.lit(False)
        for e in CODE_EXTENSIONS:
            ends = ends | low.endswith(e)
        hump = token.rlike(r"^\p{Lu}[\p{L}\p{N}]*$") & token.rlike(r"[\p{Ll}\p{N}]\p{Lu}") & token.rlike(r"\p{Ll}") & ~low.isin([k.lower() for k in known] or [""])
        bad = raw.contains("()") | token.contains("::") | (token.contains("_") & token.rlike(r"\p{L}")) | ends | (token.contains("/") & (F.octet_length(token) > 5) & (low != "and/or")) | token.isin(HTTP_VERBS) | low.isin(TECHNICAL_WORDS) | hump
        return F.when((token != "") & bad, low)

    return F.array_distinct(F.filter(F.transform(F.split(text, r"\s+"), leak), lambda x: x.isNotNull()))


def _joined(words: Column) -> Column:
    one = F.transform(words, lambda w: F.when(w.endswith("s") & (F.octet_length(w) > 4), F.left(w, F.length(w) - 1)).otherwise(w))
    return F.concat(F.lit(" "), F.array_join(one, " "), F.lit(" "))


def mentions(text: Column, name: Column) -> Column:
    """Whether the name's words stand in a row in the text, without case and plural s."""
    return (F.size(identifier_words(name)) > 0) & _joined(identifier_words(text)).contains(_joined(identifier_words(name)))


def route_segments(path: Column) -> Column:
    """Segments of a route; placeholders are a star, the last segment loses its extension."""
    parts = _present(F.split(path, "/"))
    return F.transform(parts, lambda p, i: F.when(p.rlike(r"^[:{<*]"), F.lit("*")).otherwise(F.when(i == F.size(parts) - 1, F.substring_index(p, ".", 1)).otherwise(p)))


def route_covers(a: Column, b: Column) -> Column:
    """Whether the segments a are a prefix of b."""
    return F.slice(b, F.lit(1), F.greatest(F.size(a), F.lit(1))) == F.when(F.size(a) == 0, F.slice(b, 1, 1)).otherwise(a)


def citation(text: Column) -> Column:
    """struct<file, start_line, end_line> of file:start-end, file:line or file."""
    ranged = text.rlike(r":[0-9]+(-[0-9]+)?$")
    a = F.regexp_extract(text, r":([0-9]+)(-[0-9]+)?$", 1)
    b = F.regexp_extract(text, r":[0-9]+-([0-9]+)$", 1)
    start = F.when(a != "", a.cast("int"))
    end = F.when(b != "", b.cast("int")).otherwise(start)
    return F.struct(F.when(ranged, F.regexp_extract(text, r"^(.*):[0-9]+(-[0-9]+)?$", 1)).otherwise(text).alias("file"), F.least(start, end).alias("start_line"), F.greatest(start, end).alias("end_line"))


def line_span(start: Column, end: Column) -> Column:
    """Both bounds in order, one standing for both; null without a start."""
    e = F.coalesce(end, start)
    return F.when(start.isNotNull(), F.struct(F.least(start, e).alias("start_line"), F.greatest(start, e).alias("end_line")))


def percent(count: Column, total: Column) -> Column:
    """Rounded share of 100, never 0 or 100 unless it is none or all; null of nothing."""
    r = F.floor((count * 100 + F.floor(total / 2)) / total).cast("int")
    return F.when(total > 0, F.when((count == 0) | (count >= total), r).otherwise(F.greatest(F.lit(1), F.least(F.lit(99), r))))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def entry_point_name(entry_id: Column) -> Column:
    """The part after # when what precedes it looks like a file."""
    left = F.substring_index(entry_id, "#", 1)
    return F.when(entry_id.contains("#") & left.rlike("[./]"), F.regexp_extract(entry_id, "^[^#]*#(.*)$", 1)).otherwise(entry_id)
