"""Column functions on text; all run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish capitals and what they become. Plain ``lower`` makes a dotted
#: capital I two characters, which breaks every later match.
TR_UPPER, TR_LOWER = "İIŞĞÜÖÇ", "iışğüöç"
QUOTES, PLAIN_QUOTES = "’‘“”", "''\"\""
ACCENTED, PLAIN = "çğişöüâîûáàäãéèêëíìïóòôõúùñý", "cgisouaiuaaaaeeeeiiioooouuny"
#: White space in the wide sense: what Python's ``\s`` takes, no-break space included.
WIDE_SPACE = r"[\s   -     　\u0085\u001c-\u001f]+"
#: Where none of these stands, nor two blanks in a row, single blanks are all there is of it.
ODD_SPACE = r"[\t\n\x0B\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u205f\u3000]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: an expression named inside a lambda would
    be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _turned(s: Column, within: Column, what: str, to: str) -> Column:
    """``translate`` of ``within``, a form of ``s`` with the same capitals and quotes, where any of the
    characters stands in ``s``: it looks up each character, and most texts hold none of them. The
    capital I, which many hold, is replaced apart."""
    if "I" in what:
        at = what.index("I")
        within = F.when(F.contains(s, F.lit("I")), F.replace(within, F.lit("I"), F.lit(to[at]))).otherwise(within)
        what, to = what[:at] + what[at + 1 :], to[:at] + to[at + 1 :]
    held = reduce(lambda a, b: a | b, [F.contains(s, F.lit(c)) for c in what])
    return F.when(held, F.translate(within, what, to)).otherwise(within)


def tr_lower(s: Column) -> Column:
    return F.lower(F.translate(s, TR_UPPER, TR_LOWER))


def fold(s: Column) -> Column:
    """For matching: lower case, plain quotes, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(tr_lower(s), QUOTES, PLAIN_QUOTES), WIDE_SPACE, " "))


def lower_text(s: Column) -> Column:
    """``tr_lower`` for columns of whole texts. The argument is named many times, so it must be a
    column or a variable, not an expression to compute."""
    return F.lower(_turned(s, s, TR_UPPER, TR_LOWER))


def fold_text(s: Column) -> Column:
    """``fold`` for columns of whole texts, as ``lower_text``."""
    spaced = F.contains(s, F.lit("  ")) | s.rlike(ODD_SPACE)
    single = F.when(spaced, F.regexp_replace(s, WIDE_SPACE, " ")).otherwise(s)
    return F.trim(F.lower(_turned(s, single, TR_UPPER + QUOTES, TR_LOWER + PLAIN_QUOTES)))


def deaccent(s: Column) -> Column:
    """Lower case without accents, for a second, looser try. Covers the closed set
    ACCENTED and combining marks; a dotless i stays."""
    bare = F.lower(F.replace(s, F.lit("I"), F.lit("ı")))
    return F.when(F.length(s) == F.octet_length(s), bare).otherwise(_deaccented(s))


def _deaccented(s: Column) -> Column:
    return F.regexp_replace(F.translate(tr_lower(s), ACCENTED, PLAIN), r"\p{Mn}", "")


def snippet(s: Column, start: Column, end: Column, pad: int = 0) -> Column:
    """``s[start:end]`` with ``pad`` characters on both sides, trimmed."""
    first = F.greatest(F.lit(0), start - pad)
    return F.trim(F.substring(s, first + 1, F.greatest(F.lit(0), F.least(F.length(s), end + pad) - first)))


def safe_name(name: Column) -> Column:
    """A file name of word characters, dots and dashes, at most 120 long."""
    return F.substring(F.regexp_replace(name, r"(?U)[^\w.\-]+", "_"), 1, 120)


def mask_key(key: Column, shown: int = 4) -> Column:
    """First and last characters of a secret; short ones vanish whole."""
    return F.when(F.length(key) > 2 * shown + 2, F.concat(F.left(key, F.lit(shown)), F.lit("…"), F.right(key, F.lit(shown)))).otherwise(F.lit("…"))


def client_ip(forwarded: Column, socket: Column) -> Column:
    """First forwarded hop, else the peer."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), socket)


#: What messages of a failed model call say, quota first: some providers
#: answer a used-up quota with 403.
QUOTA_WORDS = ("quota", "exhausted", "429", "rate limit", "kota", "insufficient", "billing")
AUTH_WORDS = ("401", "403", "invalid", "authentication", "api key")
MODEL_WORDS = ("404", "not found", "no longer available", "not supported", "desteklenmiyor", "kabul edilmedi", "model_not_found")


def error_class(message: Column) -> Column:
    """quota, auth, model or other: the first class of which a phrase stands in the message."""
    says = lambda words: F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(words))
    return F.when(says(QUOTA_WORDS), "quota").when(says(AUTH_WORDS), "auth").when(says(MODEL_WORDS), "model").otherwise("other")


def json_text(text: Column) -> Column:
    """The text of the JSON object in a reply: from the first brace to the last, so fences and
    words around it are gone, and fences inside strings stay. Null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_object(text: Column) -> Column:
    """``json_text`` as a variant; null where it does not parse."""
    return F.try_parse_json(json_text(text))


def text_layer_too_thin(text: Column, pages: Column, least: int = 120) -> Column:
    """Fewer than ``least`` characters other than white space a page: likely a scan."""
    return F.length(F.regexp_replace(text, WIDE_SPACE, "")) / F.greatest(pages, F.lit(1)) < least


def first_sentence(text: Column, limit: int = 300) -> Column:
    head = F.substring(F.trim(text), 1, limit)
    found = F.regexp_extract(head, r"(?s)^(.*?[.;])\s", 1)
    return F.when(found != "", found).otherwise(F.trim(head))


def bare_quote(quote: Column) -> Column:
    """A claimed quote without white space and quotation marks around it."""
    return F.btrim(F.btrim(F.btrim(F.regexp_replace(quote, rf"^{WIDE_SPACE}|{WIDE_SPACE}$", ""), F.lit('"')), F.lit("«»")), F.lit("“”"))


def folded_places(s: Column) -> Column:
    """struct<folded, places>: ``s`` folded for matching, and for each of its characters the place
    (0-based, in code points) of the one in ``s`` that it stands for. Each character folds to
    one; of a run of white space the first is kept, as a blank, and none at the ends."""
    same_length = F.regexp_replace(F.translate(tr_lower(s), QUOTES, PLAIN_QUOTES), WIDE_SPACE[:-1], " ")
    kept = let(F.split(same_length, ""), lambda c: F.filter(F.transform(c, lambda x, i: F.when((x != " ") | ((i > 0) & (F.get(c, i - 1) != " ")), F.struct(x.alias("c"), i.alias("i")))), lambda x: x.isNotNull()))
    return let(kept, lambda k: F.struct(F.rtrim(F.array_join(F.transform(k, lambda x: x["c"]), "")).alias("folded"), F.transform(k, lambda x: x["i"]).alias("places")))


def _spaced_pattern(folded: Column) -> Column:
    """A pattern of folded text as it may stand before blanks were joined. Folded text has no
    capital that could end the quoting."""
    return F.concat(F.lit("\\Q"), F.replace(folded, F.lit(" "), F.lit("\\E +\\Q")), F.lit("\\E"))


def quote_span(hay: Column, quote: Column, least: int = 12, index: Column | None = None) -> Column:
    """struct<start, end> (0-based, in code points of ``hay``) of a claimed quote: where it stands as
    it is, else where it stands folded: every character of ``hay`` folds to one, white space to a
    blank, and blanks of the quote stand for runs of them (or by the places that ``folded_places``
    kept, ``index``, where they are at hand). Null where it stands nowhere, and for quotes under
    ``least`` characters, which are never evidence."""
    span = lambda start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))

    def by_places(q: Column) -> Column:
        def back(f: Column) -> Column:
            j = F.instr(f["folded"], q)
            return F.when(j > 0, span(F.get(f["places"], j - 1), F.get(f["places"], j + F.length(q) - 2) + 1))

        return let(index, back)

    def by_pattern(q: Column) -> Column:
        # The first match is the first place of its own string, as a place before it would match too.
        same_length = F.lower(_turned(hay, F.regexp_replace(hay, WIDE_SPACE[:-1], " "), TR_UPPER + QUOTES, TR_LOWER + PLAIN_QUOTES))
        found = lambda s: let(F.regexp_substr(s, _spaced_pattern(q)), lambda m: let(F.instr(s, m) - 1, lambda at: F.when(m.isNotNull() & (m != ""), span(at, at + F.length(m)))))
        return let(same_length, found)

    def look(bare: Column) -> Column:
        at = F.instr(hay, bare)
        folded = by_places if index is not None else by_pattern
        return F.when(F.length(bare) >= least, F.when(at > 0, span(at - 1, at - 1 + F.length(bare))).otherwise(let(fold(bare), folded)))

    return let(bare_quote(quote), look)


def quote_found(hay: Column, quote: Column, least: int = 12) -> Column:
    """Whether a claimed quote stands in ``hay``: exactly, or after folding both. Quotes
    under ``least`` characters are never evidence."""
    bare = bare_quote(quote)
    return F.coalesce((F.length(bare) >= least) & (F.contains(hay, bare) | F.contains(fold(hay), fold(bare))), F.lit(False))
