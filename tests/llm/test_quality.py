import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.quality import LIMIT, PRICE, RISK, RULES, STEPS, features, judge, most_allowed

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def slow_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)} if len(words) < 2_000 else fast_covered(windows)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def fast_covered(windows):
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    return {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 3)}


def failed(f):
    return f[0] < 50 or 100 * f[4] > 50 * f[0]


def test_features_match_brute_force(documents):
    got = {(r["doc_id"], r["n_words"]): tuple(r[c] for c in COUNTS) + (r["base_failed"],) for r in features(documents).collect()}
    expected = {}
    for r in documents.select("doc_id", "text").collect():
        f = slow_features(r["text"])
        expected[(r["doc_id"], f[0])] = (*f[:5], failed(f))
    assert got == expected


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "#", "ü|", "x<y", "日本"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t", "\n\n", "\r\n", " ", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in features(rows).collect()}
    assert got == {k: slow_features(t)[:5] for k, t in enumerate(texts)}


def slow_most(n, limit, risk):
    most, total = -1, 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * limit**k * (1 - limit) ** (n - k)
        if total > risk:
            return most
        most = k
    return most


def test_exact_binomial_bound(spark):
    ns = [0, 1, 10, 100, 300, 500, 900]
    for limit, risk in ((0.0125, 0.00625), (0.05, 0.1), (0.2, 0.01)):
        got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", most_allowed(F.col("n"), limit, F.lit(risk)).alias("k")).collect()
        assert {r["n"]: r["k"] for r in got} == {n: slow_most(n, limit, risk) for n in ns}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    docs, labels = [], []
    for k in range(2400):
        lang = "en" if k % 3 else "de"
        bad = rng.random() < 0.25
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}w" for _ in range(rng.randint(60, 90))]
        if bad:
            words = [w if rng.random() < 0.6 else "##||" for w in words]
        docs.append((k, " ".join(words), lang, "s", 0))
        if k % 4 != 1:
            labels.append((k, int(not bad), 0))
    docs.append((9999, " ".join(f"w{i}" for i in range(60)), None, None, 0))
    labels += [(0, None, 0), (None, 1, 0), (77777, 1, 0)]
    return spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def slow_kept(docs, labels):
    measured = {d: (lang or "", slow_features(t)) for d, t, lang, *_ in docs}

    def first(rule, f):
        named = dict(zip((*COUNTS, "n_lines"), f, strict=True))
        return max(0, math.floor((rule.high - named[rule.part] / named[rule.whole]) * (STEPS / (rule.high - rule.low))) + 1)

    strata = sorted({measured[d][0] for d, q, _ in labels if q is not None and d in measured and not failed(measured[d][1])})
    chosen = {}
    for s in strata:
        held = [(measured[d][1], q) for d, q, _ in labels if q is not None and d in measured and measured[d][0] == s and not failed(measured[d][1])]
        good = [f for f, q in held if q]
        most = slow_most(len(good), LIMIT / len(RULES), RISK / (len(RULES) * len(strata)))
        for rule in RULES:
            best = None
            for step in range(STEPS + 1):
                wrong = sum(first(rule, f) <= step for f in good)
                right = sum(first(rule, f) <= step for f, q in held if not q)
                gain = right - PRICE * wrong
                if wrong <= most and gain > 0 and (best is None or gain > best[0]):
                    best = (gain, step)
            if best:
                chosen[s, rule.name] = best[1]
    kept = {d for d, (s, f) in measured.items() if not failed(f) and not any(first(r, f) <= chosen.get((s, r.name), -1) for r in RULES)}
    return kept, chosen


def test_verdicts_match_brute_force_and_spare_good_documents(labelled):
    docs, labels = labelled
    kept, chosen = slow_kept([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert any(name == "symbols" for _, name in chosen)
    got = judge(docs, labels)
    assert {r["doc_id"] for r in got.where("kept").collect()} == kept
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality IS NOT NULL AND doc_id < 9999").collect()}
    good = [d for d, q in truth.items() if q]
    assert sum(d not in kept for d in good) <= LIMIT * len(good)
    assert sum(d in kept for d, q in truth.items() if not q) < 0.1 * (len(truth) - len(good))


def test_without_labels_only_base_rules_count(documents, labelled):
    got = judge(documents, labelled[1].limit(0), whole=True)
    assert got.where("kept <> (NOT base_failed)").count() == 0
    assert got.select("document.*").columns == documents.columns


def test_empty_table(empty, labelled):
    assert judge(empty, labelled[1]).count() == 0
