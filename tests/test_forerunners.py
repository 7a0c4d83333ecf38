"""What is sought before a pattern is tried stands wherever the pattern matches."""

import random

from pyspark.sql import functions as F

from pactum.functions.text import _deaccented, deaccent, fold_text
from pactum.operators import meta, rules

BITS = ["3", "12", "bir", "BİR", "iki", "üç", "ÜÇ", "dört", "BEŞ", "beſ", "altı", "ALTI", "yirmi dört", " ", "  ", "\n", "(", ")", "ay", "AY", "Ay", "aylık", "ayı", "yıl", "YIL", "Yil", "YİL", "yıllık", "may", "say", ".", ",", "sözleşme süresi", "uzar", "TL", "1.500", "EUR", "damga vergisi", "DAMGA  VERGİSİ", "Damga\nVergisi", "banka", "eşit", "kendiliğinden", "KENDİLİĞİNDEN", "otomatik olarak", "yenilenir", "YENİLENİR", "EK", "Ek-", "eK", "–", "bedeli", "MASRAFI", "tarafından", "TARAFINDAN", "tarafindan", "tarafİndan", "_____", "____", "……", "…", "......", "I", "â", "é"]


def texts(n=12000):
    rng = random.Random(5)
    return ["".join(rng.choice(BITS) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_forerunners_stand_where_patterns_match(spark):
    t = F.col("t")
    blank = F.contains(t, F.lit(rules.BLANKS[0])) | F.contains(t, F.lit(rules.BLANKS[1])) | F.contains(t, F.lit(rules.BLANKS[2]))
    pairs = {
        "term": (t.rlike(meta.TERM), t.rlike(meta.UNIT)), "amount": (t.rlike(meta.AMOUNT), t.rlike(meta.DIGIT)), "stamp": (fold_text(t).contains("damga vergisi"), t.rlike(meta.STAMP)),
        "renews": (fold_text(t).rlike(meta.RENEWS), t.rlike(meta.RENEWED)), "annex": (t.rlike(rules.ANNEX), t.rlike(rules.ANNEXED)), "subject": (t.rlike(rules.NO_SUBJECT), t.rlike(rules.SUBJECTLESS)), "blank": (t.rlike(rules.BLANK), blank),
    }
    rows = spark.createDataFrame([(x,) for x in texts()], "t string")
    found = rows.select(*[F.count_if(p & ~g).alias(f"{n}_lost") for n, (p, g) in pairs.items()], *[F.count_if(p).alias(n) for n, (p, _) in pairs.items()]).first()
    assert all(found[f"{n}_lost"] == 0 and found[n] > 10 for n in pairs), found
    assert rows.filter(deaccent(t) != _deaccented(t)).isEmpty()


def test_a_term_is_sought_only_where_a_unit_stands(spark):
    """The expression names the places once: in a branch each mention would be computed anew."""
    rows = spark.createDataFrame([("sözleşme süresi 3 (üç) yıl olup uzar",), ("the day may stay",)], "t string")
    assert [r[0] for r in rows.select(meta.term(F.col("t"))).collect()] == ["3 yıl", ""]
    plan = rows.select(meta.term(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    # The matches themselves and, in ``match_places``, how many they are.
    assert plan.count("regexp_extract_all") == 2
