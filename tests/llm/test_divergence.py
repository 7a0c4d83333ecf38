"""The source divergence audit against plain loops over exact integers."""

import random
import re
from collections import Counter, defaultdict

from pactum.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, docs int, total int, vector string, value long"


def brute(rows, least=3, top=200):
    held, used, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        held[lang].update(set(terms))
        used[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: used[lang, s][t] for t in kept})
        count = {s: {t: used[lang, s][t] for t in kept} for s in sources} | {None: {t: whole[t] for t in kept}}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def audited(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, "t", 1, 1, 1, "v", 1) for i, r in enumerate(rows)], SCHEMA)
    got = [tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_texts(spark):
    rng = random.Random(3)
    words = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnop"] + ["É", "é", "ÿ", "日本", "😀", "ab1cd"]
    rows = []
    for _ in range(150):
        text = " ".join(rng.choice(words[: rng.choice([5, 30, 66])]).title() for _ in range(rng.randrange(12)))
        rows.append((text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", "é", None])))
    rows += [rows[0]] * 40
    want = brute(rows)
    assert audited(spark, rows) == want and {r[2] for r in want} == {"pair", "term"}
    assert audited(spark, rows, least_docs=1, top=3) == brute(rows, 1, 3)


def test_edges(spark):
    long = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqr'[i // 10 % 8]}" for i in range(50_000))
    rows = [(None, None, None), ("", "en", "a"), (" 12 !", "en", "b"), ("once", "en", "c"), (long, "de", "x"), (long, "de", "y"), (long + " end end", "de", "x"), ("lone lone", "fr", "s")]
    got = audited(spark, rows)
    assert got == brute(rows)
    assert {r[4] for r in got if r[0] == "en"} == {0} and not any(r[0] in ("fr", "") for r in got)
    assert audited(spark, []) == set()
    assert audited(spark, [(None, None, None)] * 5) == set()


def test_equal_vectors_are_one_row(spark):
    rows = [(" ".join(f"t{'abcdefghij'[k]}" for k in range(10)), "en", s) for s in "aabbcc"]
    counts = divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string"))
    kept = divergence.count_vectors(counts)
    assert kept.count() == 10 and kept.select("lang", "vector").distinct().count() == 1


def test_shares_are_exact(spark):
    from pyspark.sql import functions as F

    pairs = [(0, 1), (2, 7), (10**18 - 1, 10**18 + 10**9), (3 * 10**12, 7 * 10**15), (5, 10**17)]
    df = spark.createDataFrame(pairs, "c long, size long")
    assert [r[0] for r in df.select(divergence.share(F.col("c"), F.col("size"))).collect()] == [1 + 10**9 * (c + 1) // s for c, s in pairs]
