"""Quotes, keywords, red lines and vague phrases: where they stand and what they say."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pactum.functions import text as T
from pactum.operators import classify, rules
from pactum.sources import catalog


def spans(spark, rows):
    df = spark.createDataFrame(rows, "hay string, quote string")
    own = df.select(T.quote_span(F.col("hay"), F.col("quote")).alias("x"), T.quote_span(F.col("hay"), F.col("quote"), index=T.folded_places(F.col("hay"))).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in own)
    return [None if r["x"] is None else tuple(r["x"]) for r in own]


def test_quote_spans(spark):
    hay = "  Tedarikçi'nin  işbu\nSözleşme’den doğan toplam  sorumluluğu üç (3) ayı aşamaz. 😀 Son."
    cases = [
        (hay, "işbu Sözleşme'den doğan toplam sorumluluğu", "işbu\nSözleşme’den doğan toplam  sorumluluğu"), (hay, "  \"ÜÇ (3) AYI AŞAMAZ\" ", "üç (3) ayı aşamaz"), (hay, "«aşamaz. 😀 SON.»", "aşamaz. 😀 Son."),
        (hay, "toplam  SORUMLULUĞU üç", "toplam  sorumluluğu üç"), (hay, "Bu cümle sözleşmede hiç geçmiyor", None), (hay, "kısa söz", None), (hay, "", None), (hay, None, None), (None, "Tedarikçi'nin işbu", None), ("", "Tedarikçi'nin işbu", None),
    ]
    got = spans(spark, [(h, q) for h, q, _ in cases])
    assert [None if s is None else h[s[0] : s[1]] for s, (h, _, _) in zip(got, cases, strict=True)] == [w for *_, w in cases]


def test_places_of_long_texts(spark):
    hay = "kelime  ve \t\n söz " * 20_000
    (at,) = spans(spark, [(hay + "ARANAN  Cümle burada", "aranan cümle BURADA")])
    assert at == (len(hay), len(hay) + 20)


TR = "a-zçğıöşü"
KEYWORDS = ["ödeme", "hizmet seviyesi", "kişisel veri", "veri", "7/24", "e-posta", "kitap", "ve", "a b a", "sır", "gizlilik", "fikri hak", "iş günü", "süre uzat"]


def test_keywords_agree_with_their_patterns(spark):
    """Words by joins give what the patterns give, on texts made of pieces of keywords, suffixes and marks."""
    rng = random.Random(8)
    pieces = ["ödeme", "ÖDEMELERİ", "hizmet", "hizmetin", "hizmet2", "seviyesi", "seviyesinde", "kişisel", "KİŞİSEL", "veri", "verisi", "muhteveri", "7/24", "e-posta", "e-postalar", "kitap", "kitabı", "kıtab", "ve", "vesile", "a", "b", "aa", "sır", "sirlar", "gizliliğin", "fikri", "haklar", "hağ", "iş", "günü", "gün", "süre", "uzatılır", "uzadı", "-", "/", "(", ".", "12", "ſır", "日本"]
    texts = []
    for _ in range(400):
        texts.append("".join(rng.choice(pieces) + rng.choice([" ", " ", " ", "  ", "\n", "", "-", "/", ", ", " "]) for _ in range(rng.randrange(14))))
    types = catalog.build([{"code": f"T{i}", "name_tr": "t", "obligation": "ZORUNLU", "detection": {"keywords_tr": [k, *(["veri"] if i == 3 else [])]}} for i, k in enumerate(KEYWORDS)], "test")
    rows = [(0, i, texts[i - 1] if i % 3 == 0 else "", t) for i, t in enumerate(texts)]
    got = {(r["order_index"], r["code"], r["kw_pos"]): (r["in_heading"], r["n"]) for r in classify.keyword_hits(spark.createDataFrame(rows, "contract_id int, order_index int, heading string, text string"), types).collect()}
    same = lambda s: catalog.tr_fold(s.replace(" ", " "))
    want = {}
    for _, i, heading, text in rows:
        for t in types:
            for pos, k in enumerate(t.keywords):
                p = re.compile(catalog.keyword_pattern(k).removeprefix("(?iu)"), re.IGNORECASE)
                found = (p.search(same(heading)) is not None, len(p.findall(same(text))))
                if found != (False, 0):
                    want[i, t.code, pos] = found
    assert got == want and len(want) > 500 and max(n for _, n in want.values()) > 2


def clauses(spark, texts, **extra):
    rows = [("c", i, "", t, *extra.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "contract_id string, order_index int, heading string, text string" + "".join(f", {k} string" for k in extra))


@pytest.fixture(scope="module")
def types():
    return catalog.build([
        {"code": "GIVE", "name_tr": "x", "obligation": "ZORUNLU", "detection": {"keywords_tr": ["tedarikçi"]}, "red_lines": [{"id": "VER", "text": "verir", "severity": "KRITIK", "patterns": [r"\bver\b", r"aktarılır"]}, {"id": "ALICI", "text": "alıcı öder", "severity": "YUKSEK", "patterns": ["{ALICI}.{0,20}öder"]}]},
        {"code": "ONLY_NDA", "name_tr": "y", "obligation": "ZORUNLU", "applies_to": ["NDA"], "detection": {"keywords_tr": ["tedarikçi", "tedarikçi der"]}, "red_lines": [{"id": "NDA_DER", "text": "der", "severity": "KRITIK", "patterns": ["der"]}]},
    ], "test")


def test_the_place_is_that_of_the_match(spark, types):
    """An equal string before the match, in a sentence that forbids, is not the match."""
    text = "Sunucuverisi yasaktır. Tedarikçi ver der."
    got = rules.positive_red_lines(classify.classify(clauses(spark, [text, "😀😀 yasaktır. Tedarikçi 😀 ver der.", "Tedarikçi ver demek yasaktır. Veriler aktarılır, der."]), types), types).filter("code = 'GIVE'").orderBy("order_index").collect()
    assert [(r["order_index"], r["quote"]) for r in got] == [(0, "Tedarikçi ver der."), (1, "Tedarikçi 😀 ver der."), (2, "Veriler aktarılır, der.")]
    assert text[got[0]["start"] : got[0]["end"]].strip() == got[0]["quote"]


def test_names_of_buyers(spark, types):
    df = clauses(spark, ["Tedarikçi bilir, Lodos A.Ş. bedeli öder.", "Tedarikçi bilir, Karayel bedeli öder."]).withColumn("buyers", F.array(F.lit("Lodos A.Ş.")))
    got = rules.positive_red_lines(classify.classify(df, types, buyers="buyers"), types, buyers="buyers").filter("rule_id = 'ALICI'").collect()
    assert [r["order_index"] for r in got] == [0]


def test_types_that_do_not_apply_neither_score_nor_find(spark, types):
    codes = lambda kind: {c["code"] for r in classify.classify(clauses(spark, ["Tedarikçi der, tedarikçi bilir"], contract_type=kind), types, contract_type="contract_type").collect() for c in r["codes"]}
    assert codes("SAAS") == {"GIVE"} and codes("NDA") == {"GIVE", "ONLY_NDA"} and codes(None) == {"GIVE", "ONLY_NDA"}
    other = catalog.build([{"code": f"N{i}", "name_tr": "n", "obligation": "ZORUNLU", "applies_to": ["NDA"], "detection": {"keywords_tr": ["tedarikçi der ki", "tedarikçi"]}} for i in range(4)] + [{"code": "LAST", "name_tr": "z", "obligation": "ZORUNLU", "detection": {"keywords_tr": ["tedarikçi"]}}], "test")
    df = clauses(spark, ["Tedarikçi der ki tedarikçi bilir"], contract_type="SAAS")
    assert [r["code"] for r in classify.score(df, other).collect()].count("LAST") == 0
    assert [r["code"] for r in classify.score(df, other, contract_type="contract_type").collect()] == ["LAST"]


def test_vague_phrases_quote_their_sentence(spark):
    text = "İlk cümle burada biter. Tedarikçi makul bir süre içinde bildirir. Son cümle."
    row = spark.createDataFrame([(text,)], "t string").select(rules.ambiguous(F.col("t")).alias("x")).first()["x"]
    assert [(x["phrase"], x["kind"], x["quote"]) for x in row] == [("makul bir süre", "sure", "Tedarikçi makul bir süre içinde bildirir.")]
    assert text[row[0]["start"] : row[0]["end"]].strip() == row[0]["quote"]
    plain = spark.createDataFrame([("Tedarikci makul bir sure icinde bildirir.",), ("Tedarikçi yirmi dört (24) saat içinde bildirir.",)], "t string").select(F.size(rules.ambiguous(F.col("t")))).collect()
    assert [r[0] for r in plain] == [1, 0]


@pytest.mark.parametrize("message,want", [("The model is overloaded", "other"), ("model not found", "model"), ("HTTP 403: quota exhausted", "quota"), ("kota doldu", "quota"), ("Billing hard limit", "quota"), ("invalid key", "auth"), ("HTTP 401", "auth"), ("gpt is not supported", "model"), ("1404 x", "model"), ("", "other"), (None, "other")])
def test_error_classes(spark, message, want):
    assert spark.createDataFrame([(message,)], "m string").select(T.error_class(F.col("m"))).first()[0] == want


@pytest.mark.parametrize("reply,want", [('Here:\n{"a":"use ``` here"}', "use ``` here"), ('```json\n{"a": "x"}\n```', "x"), ('{"a":"{b}"} done', "{b}"), ("no object", None), ("{broken", None), ('{"a": ]}', None), (None, None)])
def test_json_replies(spark, reply, want):
    got = spark.createDataFrame([(reply,)], "r string").select(F.try_variant_get(T.json_object(F.col("r")), "$.a", "string")).first()[0]
    assert got == want


def test_quotes_with_marks_of_patterns(spark):
    """A quote is text even where it reads like the end of a quoted pattern, and its first place counts."""
    hay = r"Bir \Q iki \E  üç (a+) dört BEŞ; bir \q İKİ \e üç (A+) dört beş"
    assert spans(spark, [(hay, r"IKI \E ÜÇ (a+) DÖRT"), (hay, r"\Q İKİ \E Üç (A+) d"), (hay, r"\E ÜÇ (aa) dört")]) == [None, (4, 24), None]


def test_long_texts_are_not_taken_apart(spark):
    """No array of all characters of a text is built to find a quote in it."""
    plan = spark.createDataFrame([("a", "b")], "t string, q string").select(T.quote_span(F.col("t"), F.col("q")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "filter(" not in plan


def test_hits_of_a_clause_need_no_shuffle(spark, types):
    plan = classify.keyword_hits(clauses(spark, ["x"]), types)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_fold_keeps_its_definition(spark):
    """Guards leave out work, not characters: each alone and beside others, against the plain form."""
    marks = [*T.TR_UPPER, *T.TR_LOWER, *T.QUOTES, *"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0        　​᠎", " ", "  ", "Σ", "K", "ſ", "😀"]
    texts = [f"{a}{x}{b}" for x in marks for a in ("", "a ", "I", "Ş“") for b in ("", " b", "Z", "ÖI’")] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = T.tr_lower(F.col("t"))
    plain = T.fold(F.col("t"))
    assert [tuple(r) for r in df.select(T.fold_text(F.col("t")), T.lower_text(F.col("t"))).collect()] == [tuple(r) for r in df.select(plain, low).collect()]


def test_an_absence_reads_its_clauses_once(spark):
    absent = catalog.build([{"code": "A", "name_tr": "a", "obligation": "ZORUNLU", "detection": {"keywords_tr": ["veri"]}, "red_lines": [{"id": "NO_X", "text": "x", "absent_patterns": ["x+"]}]}, {"code": "B", "name_tr": "b", "obligation": "ZORUNLU", "detection": {"keywords_tr": ["veri sözü"]}}], "test")
    found = rules.absent_red_lines(classify.classify(clauses(spark, ["yok", "Veri, veri sözü; bir. İki.", "Veri veri y"]), absent), absent)
    assert [(r["order_index"], r["rule_id"], r["quote"]) for r in found.collect()] == [(1, "NO_X", "Veri, veri sözü;")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FullOuter") == 1
