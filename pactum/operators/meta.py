"""Parties, amount, term, stamp duty and defined terms, from the text alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text, let
from .classify import DEFAULT_BUYERS
from .rules import match_places

HEAD = 6000
#: Forms of amounts, terms, company names and defined terms.
AMOUNT = r"(?iu)(\d{1,3}(?:[.\s]\d{3})+(?:,\d{1,2})?|\d+(?:,\d{1,2})?)\s*(TL|TRY|USD|EUR|€|\$|₺|Amerikan Dolar[ıi]|Avro|T[uü]rk Liras[ıi])"
TERM = r"(?iu)(\d+|bir|iki|üç|uc|dört|dort|beş|bes|altı|alti|on iki|oniki|yirmi dört|yirmidort|otuz altı)\s*\(?\s*\d*\s*\)?\s*\b(yıl|yil|ay)[a-zçğıöşü]{0,5}\b"
PARTY = r"([A-ZÇĞİÖŞÜ][\wÇĞİÖŞÜçğıöşü.\-&'’ ]{2,60}?\s(?:A\.?Ş\.?|Ltd\.?\s*Şti\.?|LTD|LLC|GmbH|Inc\.?|B\.?V\.?|S\.?A\.?))(?![\wÇĞİÖŞÜçğıöşü])"
LEAD = r"(?iu)^(?:(?:işbu|isbu|bir\s+taraftan|diğer\s+taraftan|diger\s+taraftan|sözleşme|sozlesme|taraflar|ile|ve|arasında|arasinda)(?![\wçğıöşü])[\s:.,-]*)+"
DEFINED = "[(\\[]\\s*[\"“”'‘’]\\s*([^\"“”'‘’\\n\\]\\)]{2,45}?)\\s*[\"“”'‘’]\\s*[)\\]]"
GENERIC = ("sözleşme", "taraf", "taraflar", "ek", "ekler", "hizmet", "hizmetler", "gizli bilgi", "gizli bilgiler", "ürün", "yazılım", "sistem", "kanun", "yönetmelik", "kurum", "kurul", "veri", "personel")
SUPPLIER = ("tedarikçi", "sağlayıcı", "yüklenici", "satıcı", "firma", "şirket", "hizmet sağlayıcı", "danışman", "imalatçı", "üretici", "kiralayan")
NUMBERS = {"bir": 1, "iki": 2, "üç": 3, "uc": 3, "dört": 4, "dort": 4, "beş": 5, "bes": 5, "altı": 6, "alti": 6, "on iki": 12, "oniki": 12, "yirmi dört": 24, "yirmidort": 24, "otuz altı": 36}
RENEWS = r"(kendiliğinden|otomatik olarak)[^.]{0,40}(yenilen|uzar)"
#: What must stand in a text, unfolded, where a form above matches: each begins with few characters, so
#: most places are passed over at once, and the form itself is tried in few texts. That takes ``when``:
#: operands of ``&`` and ``|`` may be computed beforehand. A unit of a term begins at the edge of a word,
#: after white space, a bracket or the last letter of a number; i has four forms for matching.
DIGIT = "[0-9]"
UNIT = r"[yY](?:(?<=[aA].)(?<=[\s()çÇşŞıİſ]..)|(?<=[\s()çÇşŞıİſ].)[ıiIİ][lL])"
STAMP = "[dD][aA][mM][gG][aA]"
RENEWED = "[uUyY](?:[zZ][aA][rR]|[eE][nN][iİ][lL][eE][nN])"


def defined_terms(text: Column, pattern: str = DEFINED, generic: tuple[str, ...] = GENERIC, head: int = HEAD) -> Column:
    """Terms defined in quotes and brackets near the start, first seen first, generic ones out."""
    found = F.regexp_extract_all(F.substring(text, 1, head), F.lit(pattern), F.lit(1))
    clean = F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_distinct(F.filter(clean, lambda x: (x != "") & ~fold(x).isin(*generic)))


def split_terms(terms: Column, markers: tuple[str, ...] = SUPPLIER) -> Column:
    """struct<buyers, suppliers>: a term with a supplier's marker is a supplier's."""
    marked = lambda x: F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(fold(x), m))
    return F.struct(F.filter(terms, lambda x: ~marked(x)).alias("buyers"), F.filter(terms, marked).alias("suppliers"))


def buyer_names(terms: Column) -> Column:
    """Folded buyer names with the defaults, longest first."""
    own = F.transform(split_terms(terms)["buyers"], fold)
    names = F.array_distinct(F.filter(F.concat(own, F.array(*map(F.lit, DEFAULT_BUYERS))), lambda n: n != ""))
    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(names, order)


def parties(text: Column, most: int | None = 6) -> Column:
    """Company names near the start, first seen first, at most ``most`` (None: all), without the
    words that lead up to them."""
    found = F.regexp_extract_all(F.substring(text, 1, HEAD), F.lit(PARTY), F.lit(1))
    bare = lambda x: F.trim(x, F.lit(" .,-"))
    clean = F.transform(found, lambda x: bare(F.regexp_replace(bare(F.regexp_replace(x, r"\s+", " ")), LEAD, "")))
    names = F.array_distinct(F.filter(clean, lambda x: F.length(x) > 3))
    return F.slice(names, 1, most) if most else names


def counterparty(party_names: Column, terms: Column) -> Column:
    """The first party that is no buyer and no bank; else the first that is no bank; else the first."""
    buyers = F.filter(F.transform(split_terms(terms)["buyers"], fold), lambda a: F.length(a) >= 3)
    bank = lambda p: p.rlike("(?i)bank")
    own = lambda p: F.exists(buyers, lambda a: F.contains(fold(p), a) | F.contains(a, fold(p)))
    first = lambda keep: F.get(F.filter(party_names, keep), F.lit(0))
    return F.coalesce(first(lambda p: ~own(p) & ~bank(p)), first(lambda p: ~bank(p)), F.get(party_names, F.lit(0)), F.lit(""))


def amount(text: Column, pattern: str = AMOUNT) -> Column:
    """The first amount with its currency, or an empty string."""
    found = F.trim(F.concat_ws(" ", F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)))
    return F.when(text.rlike(DIGIT), found).otherwise("") if pattern == AMOUNT else found


def term(text: Column) -> Column:
    """The contract's term: a match near a word of duration and not of renewal, else one not
    near renewal, else the first. Number words become digits."""
    near = lambda m, back, ahead: fold(F.substring(text, F.greatest(F.lit(0), m["start"] - back) + 1, m["end"] + ahead - F.greatest(F.lit(0), m["start"] - back)))
    renewal = lambda s: s.rlike("uzar|yenilen")
    tier = lambda m: F.when(near(m, 90, 40).rlike("süre|sure|geçerli|gecerli") & ~renewal(near(m, 90, 40)), 0).when(~renewal(near(m, 60, 30)), 1).otherwise(2)
    ranked = F.transform(match_places(text, TERM), lambda m: F.struct(tier(m).alias("tier"), m["start"].alias("start"), m["end"].alias("end")))
    words = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])

    def told(found: Column) -> Column:
        raw, unit = fold(F.regexp_extract(found, TERM, 1)), fold(F.regexp_extract(found, TERM, 2))
        n = F.coalesce(F.element_at(words, raw), raw.try_cast("int"))
        return F.coalesce(F.concat(n.cast("string"), F.when(unit.startswith("y"), F.lit(" yıl")).otherwise(F.lit(" ay"))), F.trim(found), F.lit(""))

    best = let(F.array_min(ranked), lambda m: let(F.substring(text, m["start"] + 1, m["end"] - m["start"]), told))
    return F.when(text.rlike(UNIT), best).otherwise("")


def stamp_duty(text: Column, terms: Column) -> Column:
    """Who bears stamp duty, judged by what stands around its first mention."""
    none = F.lit("Sözleşmede düzenlenmemiş")
    near = lambda at: F.when(at >= 0, fold(F.substring(text, F.greatest(F.lit(0), at - 200) + 1, at + 300 - F.greatest(F.lit(0), at - 200))))

    def bears(around: Column) -> Column:
        buyer, equal = F.exists(buyer_names(terms), lambda a: F.contains(around, a)), around.rlike("eşit|esit")
        return F.when(around.isNull(), none).when(buyer & ~equal, "Alıcıya ait (risk)").when(equal | F.contains(around, F.lit("yarı")), "Eşit paylaşım").otherwise("Belirtilmiş (elle kontrol)")

    return F.when(~text.rlike(STAMP), none).otherwise(let(let(F.instr(fold_text(text), "damga vergisi") - 1, near), bears))


def renews(text: Column) -> Column:
    """Whether the text says that the contract renews itself."""
    return F.when(text.rlike(RENEWED), fold_text(text).rlike(RENEWS)).otherwise(False)


def extract_meta(docs: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """One row a document: parties, counterparty, value_text, term_text, stamp_duty, auto_renew, terms."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, body.alias("t"), defined_terms(body).alias("terms"), parties(body, None).alias("parties"))
    return rows.select(
        key, F.slice("parties", 1, 6).alias("parties"), counterparty(F.col("parties"), F.col("terms")).alias("counterparty"), amount(F.col("t")).alias("value_text"), term(F.col("t")).alias("term_text"),
        stamp_duty(F.col("t"), F.col("terms")).alias("stamp_duty"), renews(F.col("t")).alias("auto_renew"), "terms",
    )
