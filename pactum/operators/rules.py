"""Red lines, absences, vague phrases, dangling references, blanks, and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import deaccent, first_sentence, fold, fold_text, let, lower_text
from ..schemas import FINDING_TYPES, SEVERITIES, severity_rank
from ..sources.catalog import PLACEHOLDER, ClauseType
from .classify import buyer_pattern, matches, pattern_of

#: Phrases that cannot be measured. The first kind weakens the buyer
#: anywhere; the second is a vague duration and counts only for codes bound to time.
WEAKENING = (
    "makul çaba", "makul gayret", "makul özen", "ticari makul", "ticari olarak makul", "en iyi çaba", "en iyi gayret", "uygun gördüğü takdirde", "uygun görülmesi hâlinde",
    "uygun görülmesi halinde", "zaman zaman", "önemli ölçüde", "esaslı ölçüde", "ve benzeri", "dilediği gibi", "tek taraflı olarak", "bildirimde bulunmaksızın", "onay almaksızın",
    "kendi takdirine göre", "makul olmayan şekilde", "gerektiğinde",
)
VAGUE_TIME = ("derhal", "ivedilikle", "gecikmeksizin", "mümkün olan en kısa sürede", "makul bir süre", "makul süre içinde", "en kısa sürede")
TIME_CODES = ("BREACH_NOTIFICATION", "SLA", "ACCEPTANCE", "EXIT_TRANSITION", "WARRANTY_MAINTENANCE", "PAYMENT_TERMS", "CHANGE_MANAGEMENT", "BUSINESS_CONTINUITY", "SECURITY_TESTING", "TERMINATION")
#: Sentences that forbid what a pattern looks for, or bind it to consent.
FORBIDS = r"(?iu)\b(?:kullan|aktar|paylaş|işle|ver|sakla|kopyala|çoğalt|devred|ifşa\s+ed)\w*(?:[aeıi]m[ae]z|[ae]m[ae]z)\b|\byasak(?:tır|tir)\b"
CONSENT = r"(?iu)önceden\s+yazılı\s+onay|onayına\s+(?:tabidir|bağlıdır|bağlı)|onayı\s+(?:olmaksızın|olmadan)|yazılı\s+onayına"
ANNEX, ANNEX_HEAD = r"(?iu)\bEK\s*[-–]?\s*(\d+)", r"(?imu)^\s*EK\s*[-–]?\s*(\d+)"
NO_SUBJECT = r"(?iu)\b(tamamı|tümü|yarısı|bedeli|tutarı|masrafı|masrafları|ücreti|giderleri)\s+tarafından\b"
BLANK = r"…{2,}|_{5,}|\.{6,}"
#: What must stand in a text where the forms above match, found faster than they are.
ANNEXED, SUBJECTLESS, BLANKS = r"[eE][kK\u212A]\s*[-–]?\s*[0-9]", "[tT][aA][rR][aA][fF]", ("……", "_____", "......")
#: What claims that something is missing.
MISSING = (
    "yok", "yoktur", "eksik", "eksiktir", "bulunmamakta", "bulunmuyor", "düzenlenmemiş", "tanınmamış", "öngörülmemiş", "belirtilmemiş", "tanımlanmamış", "içermiyor", "sağlanmamış",
    "yer almıyor", "hüküm yok", "hükmü yok", "kaydı yok",
)
MISSING_WORDS = r"(?iuU)\b(?:" + "|".join(MISSING) + r")\b"
WINDOW, BACK, AHEAD, NEAR, MOST_DEFECTS = 420, 160, 200, 240, 12


def reversed_direction(sentence: Column) -> Column:
    return sentence.rlike(FORBIDS) | sentence.rlike(CONSENT)


def sentence_span(text: Column, start: Column, end: Column) -> Column:
    """struct<start, end> of the sentence that holds [start, end) (0-based). To the left the
    separators count in order of kind, not of nearness; to the right the first one ends it."""
    left = F.greatest(F.lit(0), start - WINDOW)
    before = F.substring(text, left + 1, start - left)
    begin = F.greatest(F.lit(0), start - BACK)
    for sep in reversed((". ", ".\n", "\n\n", "; ")):
        at = F.instr(F.reverse(before), sep[::-1])
        begin = F.when(at > 0, start - at + 1).otherwise(begin)
    after = F.substring(text, end + 1, F.lit(WINDOW))
    stop = F.regexp_extract(after, r"(?s)^(.*?(?:[.;]\s|\n\n))", 1)
    finish = end + F.when(stop != "", F.length(stop)).otherwise(F.least(F.length(after), F.lit(AHEAD)))
    return F.struct(begin.cast("int").alias("start"), finish.cast("int").alias("end"))


def sentence_around(text: Column, start: Column, end: Column) -> Column:
    """The sentence that holds [start, end), trimmed."""
    return let(sentence_span(text, start, end), lambda s: F.trim(F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def first_match(low: Column, raw: str, buyers: Column | None = None) -> Column:
    """struct<start, end> (0-based, in code points) of the first place where a red-line pattern
    matches lower-cased text, or null. The place is that of the match itself: an equal string
    before it, which the pattern passes over, does not count."""
    p = pattern_of(raw, buyers)
    lead = pattern_of(f"^(.*?)(?:{raw})", buyers)
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    at = F.length(F.regexp_extract(low, lead, 1) if isinstance(lead, str) else F.call_function("regexp_extract", low, lead, F.lit(1)))
    return F.when(matches(low, raw, buyers), let(at, lambda i: F.struct(i.alias("start"), (i + F.length(F.regexp_substr(low, lit(p)))).alias("end"))))


def rule_frame(spark: SparkSession, types: list[ClauseType]) -> DataFrame:
    """One row a red line: its code, what it says, and its patterns. Small by nature."""
    flag = lambda ps: ["(?isu)" + p for p in ps]
    rows = [(t.code, r.id, r.severity, r.text, at, flag(r.patterns), flag(r.absent_patterns)) for t in types for at, r in enumerate(t.red_lines)]
    return spark.createDataFrame(rows, "code string, rule_id string, severity string, title string, rule_order int, patterns array<string>, absent_patterns array<string>")


def _filled(patterns: Column, buyers: str | None) -> Column:
    """The patterns with the names of the buyers in place."""
    names = buyer_pattern(F.col(buyers) if buyers else None)
    return F.transform(patterns, lambda p: F.when(F.contains(p, F.lit(PLACEHOLDER)), F.replace(p, F.lit(PLACEHOLDER), names)).otherwise(p))


def positive_red_lines(classified: DataFrame, types: list[ClauseType], key: str = "contract_id", buyers: str | None = None) -> DataFrame:
    """(key, order_index, code, rule_id, severity, title, quote, start, end): for each rule of a
    clause's codes the first pattern whose sentence is not turned round; one hit a rule. The
    quote is that sentence, [start, end) its place in the clause. Patterns are literals, compiled
    once a task, and only those of the clause's own codes are tried."""
    rows = classified.filter(F.size("codes") > 0).select(key, "order_index", "text", lower_text(F.col("text")).alias("low"), F.col("codes.code").alias("own"), *([buyers] if buyers else []))
    who = F.col(buyers) if buyers else None

    def rule(t: ClauseType, r) -> Column:
        places = F.array_compact(F.array(*[first_match(F.col("low"), p, who) for p in r.patterns]))
        named = [F.lit(x).alias(n) for n, x in (("code", t.code), ("rule_id", r.id), ("severity", r.severity), ("title", r.text))]
        return F.when(F.array_contains("own", t.code), F.struct(*named, places.alias("places")))

    tried = [rule(t, r) for t in types for r in t.red_lines if r.patterns]
    if not tried:
        return rows.limit(0).select(key, "order_index", *[F.lit("").alias(c) for c in ("code", "rule_id", "severity", "title", "quote")], F.lit(0).alias("start"), F.lit(0).alias("end"))
    hits = F.filter(F.array_compact(F.array(*tried)), lambda x: F.size(x["places"]) > 0)
    rows = rows.select(key, "order_index", "text", F.explode(hits).alias("x")).select(key, "order_index", "text", "x.*")
    quoted = F.transform("places", lambda m: _quoted(F.col("text"), m["start"], m["end"]))
    rows = rows.withColumn("q", F.get(F.filter(quoted, lambda q: ~reversed_direction(q["quote"])), F.lit(0))).filter("q is not null")
    return rows.select(key, "order_index", "code", "rule_id", "severity", "title", "q.quote", "q.start", "q.end")


def _quoted(text: Column, start: Column, end: Column) -> Column:
    """struct<quote, start, end>: the sentence around [start, end) and its place."""
    return let(sentence_span(text, start, end), lambda s: F.struct(F.trim(F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("quote"), s["start"].alias("start"), s["end"].alias("end")))


def code_scopes(classified: DataFrame, key: str = "contract_id", codes: list[str] | None = None) -> DataFrame:
    """(key, code, first_clause, first_text, scope): all clauses of a code in order, and the first of
    them; of ``codes`` alone, where given."""
    own = F.col("codes.code") if codes is None else F.array_intersect("codes.code", F.lit(codes).cast("array<string>"))
    rows = classified.select(key, "order_index", "text", F.explode(own).alias("code"))
    parts = rows.groupBy(key, "code").agg(F.array_sort(F.collect_list(F.struct("order_index", "text"))).alias("parts"))
    first = F.get("parts", F.lit(0))
    return parts.select(key, "code", first["order_index"].alias("first_clause"), first["text"].alias("first_text"), F.array_join("parts.text", "\n").alias("scope"))


def absent_red_lines(classified: DataFrame, types: list[ClauseType], key: str = "contract_id", buyers: str | None = None) -> DataFrame:
    """(key, order_index, code, rule_id, severity, title, quote): rules of which no pattern stands
    in any clause of the code. The code's first clause hosts the finding and lends its first
    sentence. Only clauses of codes with such rules are gathered."""
    asked = sorted({t.code for t in types if any(r.absent_patterns and not r.patterns for r in t.red_lines)})
    scopes = code_scopes(classified, key, asked).withColumn("low", lower_text(F.col("scope"))).drop("scope")
    if buyers:
        scopes = scopes.join(classified.select(key, buyers).dropDuplicates([key]), key)
    rules = rule_frame(classified.sparkSession, types).filter((F.size("absent_patterns") > 0) & (F.size("patterns") == 0))
    hits = scopes.join(F.broadcast(rules), "code").filter(~F.exists(_filled(F.col("absent_patterns"), buyers), lambda p: F.regexp_like("low", p)))
    return hits.select(key, F.col("first_clause").alias("order_index"), "code", "rule_id", "severity", "title", first_sentence(F.col("first_text")).alias("quote"))


def ambiguous(text: Column, code: Column | None = None, weakening: tuple[str, ...] = WEAKENING, vague: tuple[str, ...] = VAGUE_TIME, time_codes: tuple[str, ...] = TIME_CODES) -> Column:
    """array<struct<phrase, kind, start, end, quote>>: phrases that stand in the text, folded or
    without accents; vague durations only where the code is bound to time (or no code is
    given). ``quote`` is the sentence around the phrase, [start, end) its place."""
    timed = F.lit(True) if code is None else code.isNull() | code.isin(*time_codes)
    tests = [(p, "zayiflatici", F.lit(True)) for p in weakening] + [(p, "sure", timed) for p in vague]

    def all_of(v: Column) -> Column:
        def one(phrase: str, kind: str, asked: Column) -> Column:
            folded, bare = fold(F.lit(phrase)), deaccent(F.lit(phrase))
            found = lambda hay, p: F.struct(F.lit(phrase).alias("phrase"), F.lit(kind).alias("kind"), (F.instr(hay, p) - 1).alias("at"), F.length(p).alias("size"), F.length(hay).alias("of"))
            return F.when(asked & F.contains(v["hay"], folded), found(v["hay"], folded)).when(asked & F.contains(v["flat"], bare), found(v["flat"], bare))

        return F.array_compact(F.array(*[one(*x) for x in tests]))

    def quoted(x: Column) -> Column:
        at = approximate_offset(x["at"], F.length(text), x["of"])
        return let(let(at, lambda i: _quoted(text, i, i + x["size"])), lambda q: F.struct(x["phrase"].alias("phrase"), x["kind"].alias("kind"), q["start"].alias("start"), q["end"].alias("end"), q["quote"].alias("quote")))

    # Folded once a text, however many phrases are tried.
    return F.transform(let(F.struct(fold_text(text).alias("hay"), deaccent(text).alias("flat")), all_of), quoted)


def approximate_offset(folded_at: Column, length: Column, folded_length: Column) -> Column:
    """A place in folded text carried back by the ratio of lengths: near, not exact."""
    return F.greatest(F.lit(0), F.least(F.floor(folded_at * (length / F.greatest(folded_length, F.lit(1)))), length - 1)).cast("int")


def missing_annexes(text: Column, ref: str = ANNEX, head: str = ANNEX_HEAD) -> Column:
    """Numbers referred to without a heading of their own, in numeric order."""
    numbers = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: x.cast("long"))
    return F.array_sort(F.array_distinct(F.array_except(numbers(ref), numbers(head))))


def match_places(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of all matches, by the lengths of what lies between them."""
    parts, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.zip_with(found, F.slice(parts, 1, F.size(found)), lambda m, before: F.struct(F.length(before).alias("skip"), F.length(m).alias("take")))

    def step(state, x):
        last = F.when(F.size(state) == 0, 0).otherwise(F.try_element_at(state, F.lit(-1))["end"])
        start = last + x["skip"]
        return F.concat(state, F.array(F.struct(start.cast("int").alias("start"), (start + x["take"]).cast("int").alias("end"))))

    return F.aggregate(pairs, F.array().cast("array<struct<start:int,end:int>>"), step)


def near_blocks(events: DataFrame, key: str, at: str, until: str, near: int = NEAR) -> DataFrame:
    """(key, block, start, end, n): intervals closer than ``near`` joined, as islands."""
    w = Window.partitionBy(key).orderBy(at, until)
    reach = F.max(until).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(at) - reach >= near), 1).otherwise(0)
    rows = events.select(key, at, until, opens.alias("opens")).withColumn("block", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "block").agg(F.min(at).alias("start"), F.max(until).alias("end"), F.count(F.lit(1)).alias("n"))


def drafting_defects(docs: DataFrame, key: str = "contract_id", text: str = "text") -> DataFrame:
    """(key, seq, severity, kind, quote): sentences without a subject, and unfilled blanks, near
    ones as one; at most twelve a document, sentences first."""
    body = F.col(text)
    subject = docs.filter(body.rlike(SUBJECTLESS)).select(key, text, F.posexplode(match_places(body, NO_SUBJECT)).alias("seq", "x")).select(key, "seq", F.lit("YUKSEK").alias("severity"), F.lit("SUBJECT").alias("kind"), sentence_around(body, F.col("x.start"), F.col("x.end")).alias("quote"))
    blanked = docs.filter(F.contains(body, F.lit(BLANKS[0])) | F.contains(body, F.lit(BLANKS[1])) | F.contains(body, F.lit(BLANKS[2])))
    blanks = near_blocks(blanked.select(key, F.explode(match_places(body, BLANK)).alias("x")).select(key, F.col("x.start").alias("s"), F.col("x.end").alias("e")), key, "s", "e")
    around = F.substring(body, F.greatest(F.lit(0), F.col("start") - 70) + 1, F.col("end") - F.greatest(F.lit(0), F.col("start") - 70) + 70)
    quote = F.substring(F.concat(F.lit("…"), F.trim(F.regexp_replace(around, r"\s+", " ")), F.lit("…")), 1, 300)
    holes = blanks.join(docs.select(key, text), key).select(key, (F.lit(1_000_000) + F.col("block")).cast("int").alias("seq"), F.lit("ORTA").alias("severity"), F.lit("BLANK").alias("kind"), quote.alias("quote"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("seq", "quote"))
    return subject.unionByName(holes).withColumn("seq", rank).filter(F.col("seq") <= MOST_DEFECTS)


def rule_findings(hits: DataFrame, kind: str) -> DataFrame:
    """Findings of red-line hits: ``kind`` PATTERN or ABSENCE. A rule named ONE_SIDED says so;
    the quote of an absence is context, no evidence."""
    absence = kind == "ABSENCE"
    finding = F.when(F.contains(F.col("rule_id"), F.lit("ONE_SIDED")), "ONE_SIDED").otherwise("WEAK" if absence else "RED_LINE")
    return hits.withColumns({"finding_type": finding, "confidence": F.lit(0.75 if absence else 0.85), "quote_is_evidence": F.lit(not absence), "detected_by": F.lit("RULE")})


def ambiguous_findings(classified: DataFrame, key: str = "contract_id") -> DataFrame:
    """Vague phrases of classified clauses, each quoted with its sentence. Texts are searched once,
    whatever their codes; durations then stay with codes bound to time."""
    rows = classified.filter(F.size("codes") > 0).select(key, "order_index", F.col("codes.code").alias("own"), F.explode_outer(ambiguous(F.col("text"))).alias("x"))
    # Outer: a filter that an inner explode infers would search each text again.
    rows = rows.filter("x is not null")
    rows = rows.select(key, "order_index", "x", F.explode("own").alias("code")).filter((F.col("x.kind") != "sure") | F.col("code").isin(*TIME_CODES))
    return rows.select(key, "order_index", "code", F.lit("AMBIGUOUS").alias("finding_type"), F.when(F.col("x.kind") == "zayiflatici", "ORTA").otherwise("DUSUK").alias("severity"), F.col("x.phrase").alias("title"), F.col("x.quote").alias("quote"), F.lit(0.7).alias("confidence"), F.lit(True).alias("quote_is_evidence"), F.lit("RULE").alias("detected_by"))


def coerced(findings: DataFrame) -> DataFrame:
    """Model output made to fit: unknown severities become ORTA, unknown types WEAK, and a red
    line whose text says something is missing is a weakness."""
    claims = F.concat_ws(" ", "title", "rationale").rlike(MISSING_WORDS)
    kind = F.when(F.col("finding_type").isin(*FINDING_TYPES), F.col("finding_type")).otherwise("WEAK")
    return findings.withColumns({"severity": F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("ORTA"), "finding_type": F.when((kind == "RED_LINE") & claims, "WEAK").otherwise(kind)})


def allowed_basis(basis: Column, catalogue_basis: Column) -> Column:
    """Bases the catalogue lists; repeats stay."""
    return F.filter(basis, lambda x: F.array_contains(catalogue_basis, x))


def dedupe(findings: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """One finding a key: highest severity, then confidence, then first seen; lenses united."""
    w = Window.partitionBy(*keys)
    best = F.row_number().over(w.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("confidence"), seq))
    lens = F.array_join(F.array_sort(F.collect_set(F.nullif("lens", F.lit(""))).over(w)), ", ")
    return findings.withColumns({"r_": best, "lens": lens}).filter("r_ = 1").drop("r_")


def dedupe_findings(findings: DataFrame, key: str = "contract_id") -> DataFrame:
    """Key: clause, code and type; for vague phrases the phrase takes the place of the code."""
    vague = F.col("finding_type") == "AMBIGUOUS"
    keyed = findings.withColumns({"k1_": F.when(vague, F.lit("AMBIGUOUS")).otherwise(F.col("code")), "k2_": F.when(vague, F.col("title")).otherwise(F.col("finding_type"))})
    return dedupe(keyed, [key, "clause_number", "k1_", "k2_"]).drop("k1_", "k2_")
