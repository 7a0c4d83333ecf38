"""The registered queries against brute force, exact round trips or held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from oracle import differences

from pactum.llm import chat, fingerprints, jaccard_join, license_scan, mixing, piece_encoding, queries, warc
from pactum.llm.lattice import PieceTable

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    assert differences(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def _components(texts, n, num):
    sets = {}
    for i, t in texts.items():
        ws = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if not a or not b or 100 * min(len(a), len(b)) < num * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= num * (len(a) + len(b) - both):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op8(spark, sf, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op8_ngram_jaccard_join(spark, sf).collect()}
    assert got == _components({i: r["text"] for i, r in documents.items()}, 4, 85)


def test_op8_chains_and_threshold(spark):
    """Texts that link only through others, hubs, and pairs at and just under the threshold."""
    rng = np.random.default_rng(5)
    texts, i = {}, 0
    for _ in range(12):
        ws = [f"w{x}" for x in rng.integers(0, 4000, 60)]
        for _ in range(8):
            texts[i], i = " ".join(ws), i + 1
            ws[int(rng.integers(0, 60))] = f"v{rng.integers(0, 10**6)}"
    common = " ".join(f"c{k}" for k in range(15))
    for k in range(40):
        texts[i], i = common + " " + " ".join(f"u{k}-{m}" for m in range(rng.integers(1, 8))), i + 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n, percent in ((4, 85), (5, 80), (1, 50)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(df, n, percent).collect()}
        assert got == _components(texts, n, percent)


def test_op2(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op2_license_scan(spark, sf).collect()}
    notices = [(label, set(license_scan.pairs_of(t.split())), license_scan.step_words(t)) for label, t in license_scan.NOTICES]
    for i, r in documents.items():
        ws = re.findall(license_scan.WORD, (r["text"] or "").translate(LOWER))
        base = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        labels, best = {b for _, b in base}, 1.0 if base else 0.0
        for label, notice, step in notices:
            for start in range(0, len(ws), step):
                share = len(set(license_scan.pairs_of(ws[start : start + 2 * step + 1])) & notice) / len(notice)
                if share >= (1.0 if len(notice) < license_scan.SHORT else license_scan.THRESHOLD):
                    labels.add(label)
                    best = max(best, share)
        want = (len(ws), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)))
        g = got[i]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"], g["labels"]) == want
        assert g["score"] == pytest.approx(best)


def test_op3(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op3_lm_scoring(spark, sf).collect()}
    tokens = {i: (r["text"] or "").encode().lower().split() + [None] for i, r in documents.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in documents}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert g["score"] < 0
    unseen = [i for i in held if held[i]]
    assert sum(got[i]["score"] for i in unseen) > sum(got[i]["base_score"] for i in unseen) * 2


def _all_segmentations(word, weight, unknown):
    if not word:
        return 1.0
    return sum((weight.get(word[:k]) or (unknown if k == 1 else 0.0)) * _all_segmentations(word[k:], weight, unknown) for k in range(1, len(word) + 1))


def test_marginals_sum_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]
    weights = {p: 0.05 + 0.03 * i for i, p in enumerate(pieces)}
    words = ["a", "abab", "bazab", "", "ababababababab"]
    got = PieceTable(pieces).log_marginals(words, np.array([[weights[p]] for p in pieces]), 1e-4)[:, 0]
    assert got == pytest.approx([math.log(_all_segmentations("▁" + w, weights, 1e-4)) for w in words])


def test_op4(spark, sf, documents):
    query = queries.op4_source_mixing(spark, sf)
    rows = {r["doc_id"]: r for r in query.collect()}
    sizes = defaultdict(int)
    for i, r in documents.items():
        assert rows[i]["size"] == len(WORDS.findall(r["text"] or ""))
        sizes[r["source"]] += rows[i]["size"]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, target, free = Fraction(3, 2) * sum(sizes.values()), {}, set(sizes)
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rate > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] if over else weight[s] * rate for s in over or free}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = defaultdict(int)
    for i, r in documents.items():
        assert rows[i]["source_size"] == sizes[r["source"]] and rows[i]["target"] == pytest.approx(float(target[r["source"]]))
        assert 0 <= rows[i]["taken"] <= 2 * rows[i]["size"]
        taken[r["source"]] += rows[i]["taken"]
    assert all(abs(taken[s] - float(target[s])) <= 1 for s in sizes)
    assert rows == {r["doc_id"]: r for r in queries.op4_source_mixing(spark, sf).collect()}


def test_sainte_lague(spark):
    weights, seats = [503, 301, 120, 120, 7, 0], 37
    df = spark.createDataFrame([(i, float(w), seats) for i, w in enumerate(weights)], "p int, w double, s long")
    got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df, [], "w", "s", ["p"]).collect()}
    ranked = sorted((-w / (2 * k - 1), i) for i, w in enumerate(weights) for k in range(1, seats + 1))[:seats]
    assert got == {i: sum(x == i for _, x in ranked) for i in range(len(weights))}


def test_op6_held_out_accuracy(spark, sf, documents):
    rows = queries.op6_language_id(spark, sf).collect()
    judged = [r for r in rows if r["held_out"] and documents[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert len(judged) > 20 and sum(r["lang_pred"] == documents[r["doc_id"]]["lang"] for r in judged) >= 0.9 * len(judged)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_op7(spark, sf):
    talks = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    talks[-1] = [(0, "user", queries.PROBE), (1, "assistant", queries.PROBE)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for k, turns in talks.items():
        loss = "".join(t for _, role, t in sorted(turns) if role == "assistant")
        want[k] = (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in sorted(turns))), len(loss), sha(loss))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op7_chat_formatting(spark, sf).collect()}
    assert got == want


def test_no_control_string_in_escaped_text(spark):
    nasty = ["[INST]", "[[INST]", "<&s></s>", "[&&/ROLE]", "[|][|]", "a[SYS]b</s", "[ROLE", "<s>" * 3]
    df = spark.createDataFrame([(t,) for t in nasty], "t string")
    t = chat.Template()
    for r in df.select("t", chat.escape(df["t"], t).alias("e"), chat.unescape(chat.escape(df["t"], t), t).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in ("[INST]", "[/INST]", "<s>", "</s>", "[SYS]", "[ROLE]", "[/ROLE]", "[|]"))


def test_op10(spark, sf, documents):
    rows = {r["doc_id"]: r for r in queries.op10_document_fingerprints(spark, sf).collect()}
    order = sorted(documents, reverse=True)
    prints = {}
    for k, i in enumerate(order):
        text, after = documents[i]["text"] or "", documents[order[(k + 1) % len(order)]]["text"] or ""
        cut = len(text) // 2
        edited, r = text[: len(text) - cut] + after[:cut], rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        same = next((j for j, (a, b) in enumerate(zip(text, edited, strict=False)) if a != b), min(len(text), len(edited)))
        assert r["common_prefix"] == same
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(set(prints.values())) > 0.9 * len(prints)


def test_spans_and_extensions():
    powers = fingerprints.Powers()
    text, other = "abracadabra abracadabra 😀 abra", "xx abracadabra 😀 abbra"
    x, y = (fingerprints.Prefixes(fingerprints.points(t), powers) for t in (text, other))
    for i in range(len(text)):
        for j in range(len(other)):
            want = 0
            while i + want < len(text) and j + want < len(other) and text[i + want] == other[j + want]:
                want += 1
            assert fingerprints.common_extension(x, i, y, j) == want


def test_op1_round_trip(spark, sf, documents):
    rows = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, sf).collect()}
    for i, r in documents.items():
        text = r["text"] or ""
        assert rows[i]["same"] and rows[i]["n_chars"] == len(text) and rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op1_best_path(spark):
    texts = ["the quick brown fox", "Straße  und\tGrüße", "internationalization 12345", "日本 😀"]
    pieces, longest, _ = piece_encoding.piece_table(spark, piece_encoding.VOCABULARY)
    score = {r["piece"]: r["score"] for r in pieces.collect()}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in piece_encoding.encode(df).collect():
        total = 0.0
        for chunk in piece_encoding.cutter().split(texts[r["doc_id"]]):
            best = [0.0] + [-math.inf] * len(chunk)
            for e in range(1, len(chunk) + 1):
                for s in range(max(0, e - longest), e):
                    w = score.get(chunk[s:e], piece_encoding.UNKNOWN_SCORE if e - s == 1 else -math.inf)
                    best[e] = max(best[e], best[s] + w)
            total += best[-1]
        assert r["score"] == pytest.approx(total)


def test_warc_reader_rejects_damage():
    records = [warc.record(i, "http://a/b", b"payload %d" % i * 40, None) for i in range(5)]
    whole = warc.archive(records)
    assert [warc.parse(x)["payload"] for x in warc.frames(whole)] == [b"payload %d" % i * 40 for i in range(5)]
    for bad in (whole[:5], b"\0" * 40, whole[:-9]):
        with pytest.raises(Exception):  # noqa: B017
            list(warc.frames(bad))
    for bad in (records[0].replace(b"WARC/1.1", b"WARC/9"), records[0][:-1], records[0].replace(b"payload 0p", b"payload 1p", 1), records[0].replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse(bad)
