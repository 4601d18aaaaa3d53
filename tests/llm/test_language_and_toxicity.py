"""Language mixtures and toxicity: held-out accuracy, and plain versions of their parts."""

from __future__ import annotations

import collections
import itertools
import math
import random
import string

import numpy as np
from rows import TEXTS, empty_table, odd_rows, odd_table

import corpus_pipeline
from pyspark.sql import functions as F
from tickwright.llm import language_id, toxicity
from tickwright.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = QUERIES["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98
    assert found.filter("score < 0 OR score > 1").count() == 0


def model():
    return language_id.LanguageModel


def two_languages(spark):
    rows = [(at, text, lang, None) for at, (text, lang) in enumerate(itertools.chain(
        [(" ".join("the thin father then them".split()[i % 5:]) + " with that other", "xx") for i in range(20)],
        [(" ".join("zuzu kolo mopo buku".split()[i % 4:]) + " loko puko zomu", "yy") for i in range(20)]))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_mixtures_and_noise(spark):
    fitted = language_id.LanguageModel.fit(two_languages(spark))
    assert fitted.languages == ["xx", "yy"]
    only, noise = fitted.mixture("then the father with them " * 5)
    assert [lang for lang, _ in only] == ["xx"] and noise < 0.3
    both, _ = fitted.mixture("then the father with them that other " * 10 + "zuzu kolo mopo buku loko " * 10)
    assert {lang for lang, _ in both} == {"xx", "yy"} and all(share > 0.2 for _, share in both)
    assert fitted.mixture("123 !!! \n") == ([], 1.0)


def plain_trigrams(text):
    """Three letters at a time, in lower case, anything else being one space; there is a space
    on either side, also of a text that ends in something else."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    end = " " if letters.endswith(" ") else ""
    joined = " " + " ".join(letters.split()) + end + " " if letters.split() else ""
    return [joined[at:at + 3] for at in range(len(joined) - 2)]


def test_trigrams_are_those_of_a_plain_loop():
    draw, numbers = random.Random(2), {}
    for _ in range(300):
        text = "".join(draw.choice("aBcé 中 1.\n-ß") for _ in range(draw.randint(0, 30)))
        plain, found = plain_trigrams(text), language_id.trigrams(text).tolist()
        assert len(plain) == len(found), repr(text)
        for gram, number in zip(plain, found, strict=True):
            assert numbers.setdefault(gram, number) == number


def plain_mixture(model, text):
    """Expectation-maximisation and the choice of languages in plain loops."""
    counts, noise = collections.Counter(language_id.trigrams(text).tolist()), len(model.languages)
    if not counts:
        return {}
    p = {gram: [math.exp(float(x) - float(max(model.log_p[gram]))) for x in model.log_p[gram]] for gram in counts}
    weight = {gram: n * language_id.TEMPER for gram, n in counts.items()}

    def shares_of(chosen, start):
        shares = list(start)
        for _ in range(language_id.ROUNDS):
            parts = [0.0] * len(chosen)
            for gram, n in weight.items():
                mixed = sum(p[gram][c] * s for c, s in zip(chosen, shares, strict=True))
                for at, c in enumerate(chosen):
                    parts[at] += n * p[gram][c] * shares[at] / mixed
            shares = [part / sum(weight.values()) for part in parts]
        return shares, sum(n * math.log(sum(p[gram][c] * s for c, s in zip(chosen, shares, strict=True)) + 1e-30) for gram, n in weight.items())

    everything, _ = shares_of(range(noise + 1), [1 / (noise + 1)] * (noise + 1))
    alone = [sum(n * float(model.log_p[gram][c]) for gram, n in weight.items()) for c in range(noise)]
    chosen = [alone.index(max(alone)), noise]
    own, likelihood = shares_of(chosen, [0.9, 0.1])
    for joining in sorted(set(range(noise)) - set(chosen), key=lambda c: -everything[c]):
        if everything[joining] < 1e-3:
            break
        first = max(everything[joining], 0.05)
        trial, better = shares_of([joining, *chosen], [first, *[s * (1 - first) for s in own]])
        if better - likelihood <= language_id.PENALTY * math.log(sum(counts.values()) + 1):
            break
        chosen, own, likelihood = [joining, *chosen], trial, better
    return {(*model.languages, "noise")[c]: s for c, s in zip(chosen, own, strict=True)}


def test_mixtures_are_those_of_plain_loops():
    draw = random.Random(8)
    alphabets = {"aa": "abcdefg", "bb": "efghijk", "cc": "ijklmno", "dd": "nopqrst"}

    def words(lang, n):
        return " ".join("".join(draw.choice(alphabets[lang]) for _ in range(draw.randint(2, 6))) for _ in range(n))

    counts = np.zeros((1 << language_id.BITS, 5))
    for at, lang in enumerate(alphabets):
        for number in language_id.trigrams(words(lang, 400)):
            counts[number, at] += 1
    seen = counts / np.maximum(counts.sum(axis=0), 1)
    blank = np.where(counts.sum(axis=0) > 0, language_id.UNSEEN, 1.0) / (1 << language_id.BITS)
    fitted = language_id.LanguageModel(list(alphabets), np.log((1 - language_id.UNSEEN) * seen + blank).astype(np.float32), language_id.BITS)
    sizes = collections.Counter()
    for _ in range(60):
        text = " ".join(words(lang, draw.choice([5, 40, 120])) for lang in draw.sample(list(alphabets), draw.randint(1, 3)))
        text += "xyz zyx yxz " * draw.choice([0, 0, 10])
        parts, noise = fitted.mixture(text)
        expected = plain_mixture(fitted, text)
        assert {lang for lang, _ in parts} == expected.keys() - {"noise"}
        assert abs(noise - expected["noise"]) < 1e-4 and all(abs(share - expected[lang]) < 1e-4 for lang, share in parts)
        sizes[len(parts)] += 1
    assert len(sizes) >= 2 and fitted.mixture("12 3") == ([], 1.0) and plain_mixture(fitted, "12 3") == {}


def test_language_of_odd_rows(spark):
    found = language_id.identify_documents(odd_table(spark)).collect()
    assert len(found) == len(odd_rows())
    for row in found:
        text = TEXTS.get(row.doc_id, "no id here")
        assert (row.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    assert language_id.identify_documents(empty_table(spark)).count() == 0
    unlabelled = odd_table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_documents(unlabelled).collect()} == {"und"}


def test_stage_keeps_languages_and_drops_the_rest(spark):
    docs = two_languages(spark).unionByName(spark.createDataFrame(
        [(100, None, "xx", None), (101, "", "xx", None), (102, "12 34 ?", "yy", None), (103, "ЖЩЮ ДЪ ФЫВА ЙЦУК ЪЭХ", "yy", None)],
        "doc_id long, text string, lang string, source string"))
    train_only = docs.withColumn("lang", F.when(F.col("doc_id") < 100, F.col("lang")))
    kept = corpus_pipeline.language(spark, train_only, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    assert kept.columns == docs.columns
    real = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.language(spark, real, "").count() == real.count()
    assert corpus_pipeline.language(spark, empty_table(spark), "").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "scum", "pathetic", "worthless", "moron", "idiom"]
    automaton = toxicity.LexiconAutomaton(terms)
    words = set(terms)
    for term in terms:
        for at in range(len(term) + 1):
            for letter in "aiost":
                words |= {term[:at] + letter + term[at:], term[:at] + letter + term[at + 1:], term[:at] + term[at + 1:]}
        words |= {term[2:], term[:-2], term[1:-1], term[::-1], term + "ly"}
    words |= {string.ascii_lowercase, "", "a"}
    for word in words:
        near = sorted((distance(word, t), t) for t in terms if distance(word, t) <= toxicity.allowed_edits(t))
        assert automaton.match(word) == (near[0][::-1] if near else None), word


def test_quotation_scores_lower():
    fitted = toxicity.ToxicityModel(["idiot"], {"idiot"})
    abuse, quoted, fuzzy = (dict(zip(toxicity.FEATURES, fitted.features(t), strict=True)) for t in (
        "you are an idiot and an idiot", 'she said "you idiot" to him', "such an idioot"))
    assert abuse["exact"] > 0 and abuse["crowded"] > 0 and not abuse["quoted"]
    assert quoted["quoted"] > 0 and not quoted["exact"]
    assert fuzzy["fuzzy"] > 0 and not fuzzy["exact"]


def test_quotations_of_any_length():
    long = "said " * 300
    assert toxicity.quoted_spans(f'a "{long}" b "c" d') == [(2, 4 + len(long)), (7 + len(long), 10 + len(long))]
    assert toxicity.quoted_spans('one " mark\nand "two" here ""') == [(15, 20)]
    assert toxicity.quoted_spans("„x“ “y” «z» „w”") == [(0, 3), (4, 7), (8, 11), (12, 15)]
    fitted = toxicity.ToxicityModel(["idiot"], {"idiot"})
    assert dict(zip(toxicity.FEATURES, fitted.features(f'he "{long} idiot {long}" left'), strict=True))["exact"] == 0
    assert dict(zip(toxicity.FEATURES, fitted.features(f'"{long}" idiot "{long}"'), strict=True))["quoted"] == 0


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op4_toxicity"](spark, folder).join(labels, "doc_id").filter("held_out")
    hit, wrong, missed = found.agg(F.sum((F.col("predicted") * F.col("toxic"))), F.sum(F.col("predicted") * (1 - F.col("toxic"))),
                                   F.sum((1 - F.col("predicted")) * F.col("toxic"))).first()
    assert hit / (hit + wrong) >= 0.95 and hit / (hit + missed) >= 0.88


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 1), (7, 0), (7, 1), (99, 0)], "doc_id long, toxic int")
    fitted = toxicity.fit(odd_table(spark), labels)
    found = toxicity.score_documents(odd_table(spark), fitted).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r.score <= 1 for r in found)
    nothing = toxicity.fit(empty_table(spark), labels.limit(0))
    assert all(r.score < 0.01 and r.predicted == 0 for r in toxicity.score_documents(odd_table(spark), nothing).collect())
    assert toxicity.score_documents(empty_table(spark), nothing).count() == 0
