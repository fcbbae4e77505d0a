from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartloom.llm import langid, licenses, quality
from tests.llm.conftest import SCHEMA, prose, rows_of_documents

ALPHABETS = {"aa": "aeiou", "bb": "bcdfgh", "cc": "éèêàç"}


def spoken(lang: str, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(ALPHABETS[lang] + "xyz") for _ in range(r.randint(2, 7))) for _ in range(40))


@pytest.mark.parametrize("k", [1, 2, 4, 6, 7, 15, 40])
def test_codewords_lie_apart(k):
    code = langid.codewords(k)
    assert len(code) == k
    for i in range(k):
        for j in range(i):
            assert (code[i] != code[j]).sum() >= (2 ** max(k - 2, 0) if k <= 6 else code.shape[1] // 2)


def test_a_wrong_bit_is_corrected():
    code = langid.codewords(4)
    model = langid.Model(["a", "b", "c", "d"], code, np.ones(1), np.zeros((1, 7)), np.zeros(7), np.ones(7))
    for i in range(4):
        bits = code[i] * 3
        bits[2] *= -1
        assert model.decode(bits[None])[0][0] == i
    even = model.decode(((code[0] + code[1]) / 2)[None])
    assert even[2][0] > 0.9 * even[1][0]


def test_held_out_accuracy(spark):
    rows = [(i, spoken(lang, i), lang, "s", 1) for i, lang in enumerate(list(ALPHABETS) * 60)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter("NOT held_out"), sample_rows=60)
    got = langid.predict(docs, model).filter("held_out").collect()
    assert len(got) > 20
    assert np.mean([r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got]) > 0.95
    assert np.mean([r.ambiguous for r in got]) <= 0.05


def test_mixed_and_unknown_languages_are_flagged_and_go_from_the_pipeline(spark):
    rows = [(i, spoken(lang, i), lang, "s", 1) for i, lang in enumerate(list(ALPHABETS) * 80)]
    pairs = [(a, b) for a in ALPHABETS for b in ALPHABETS if a != b]
    rows += [(1000 + i, spoken(a, 500 + i) + " " + spoken(b, 600 + i), None, "s", 1) for i, (a, b) in enumerate(pairs)]
    unknown = random.Random(7)
    rows += [(2000 + i, " ".join("".join(unknown.choice("jklmnpqrstvw") for _ in range(5)) for _ in range(60)), None, "s", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs, sample_rows=150)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert sum(got[i].ambiguous for i in range(240)) <= 5
    assert sum(got[1000 + i].ambiguous for i in range(6)) >= 5
    assert all(got[2000 + i].ambiguous for i in range(6))
    clean, mixed = ([got[i].score for i in keys] for keys in (range(240), range(1000, 1006)))
    assert np.median(clean) > 0.95 > np.median(mixed)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert sum(i in kept for i in range(1000, 1006)) <= 1 and len(kept & set(range(240))) >= 235


def test_temperature_and_bound_are_set_on_rows_that_others_predict():
    x = np.stack([langid.counts(spoken(lang, i)) for lang in ALPHABETS for i in range(40)])
    model = langid.fit(x, [lang for lang in ALPHABETS for _ in range(40)])
    best, top, _, loss = model.decode(model.margins(x))
    assert 0.9 < top.mean() < 1 and not model.beyond(x, loss).any()
    assert (np.diff(model.reach) <= 0).all() and model.reach[-1] < 2


def test_the_sample_is_bounded_whatever_keys_repeat(spark):
    rows = [(1, spoken("aa", i), "aa", "s", 1) for i in range(500)] + [(i, spoken("bb", i), "bb", "s", 1) for i in range(2, 900)]
    rows += [(None, "no key", "bb", "s", 1)]
    x, labels = langid.sample(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", "lang", 100)
    assert labels.count("aa") <= 1 and labels.count("bb") == 50 and len(x) == len(labels)


def test_language_edge_cases(docs, nothing):
    model = langid.train(docs)
    got = langid.predict(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(got) == len(rows_of_documents())
    by = {r.doc_id: r for r in got}
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (1, 2, 12))
    assert by[6].lang_pred == "en"
    assert langid.train(nothing) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text: str) -> tuple:
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen, copies = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, copies, len(covered)


def test_counts_equal_plain_code(texts):
    r = random.Random(2)
    more = ["".join(r.choice(["a", "b", " ", "\n", "\x0b", "\xa0", "#", "é"]) for _ in range(60)) for _ in range(500)]
    more += [" ".join(r.choice("abc") for _ in range(30)) for _ in range(200)]
    for t in [t for _, t in texts] + more:
        assert quality.measure(t)[:5] == plain_counts(t), repr(t)


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, prose(i, 80 + i), "en", f"s{i % 2}", 1) for i in range(200)]
    rows += [(1000 + i, " ".join(w + "&&&" for w in prose(i, 150).split()), "en", "s0", 1) for i in range(20)]
    rows += [(2000 + i, prose(i, 120), f"l{i}", None, 1) for i in range(5)] + [(3000, prose(1, 20), "en", "s0", 1), (3001, "a b c " * 60, None, "s0", 1)]
    return {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_outliers_go_and_clean_rows_stay(judged):
    assert all(judged[i].kept for i in range(200))
    assert not any(judged[i].kept or judged[i].base_failed for i in range(1000, 1020))
    assert all(judged[2000 + i].kept for i in range(5))
    assert judged[3000].base_failed and judged[3001].base_failed
    assert not judged[3000].kept and judged[3000].distance is None


def test_long_repetitive_rows_go_short_ones_and_a_third_of_junk_do_not_hide(spark):
    assert abs(quality.CUTOFF - 22.458) < 1e-3
    lines = ["\n".join(prose(10 * i + k, 12) for k in range(12)) for i in range(120)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(lines)]
    rows += [(1000 + i, " ".join(w + "&" if k % 4 == 0 else w for k, w in enumerate(prose(i, 200).split())), "en", "s", 1) for i in range(60)]
    long = [prose(7000 + k, 12) for k in range(200)]
    rows += [(2000, "\n".join(long + long[:60]), "en", "s", 1), (2001, lines[3] + "\n" + lines[3].split("\n")[0], "en", "s", 1)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i].kept for i in range(120)) >= 118
    assert not any(got[i].kept for i in range(1000, 1060))
    assert not got[2000].kept and not got[2000].base_failed and got[2001].kept


def test_junk_alone_in_its_group_is_judged_by_larger_groups(spark):
    junk = [" ".join(w + "&&&" for w in prose(500 + i, 150).split()) for i in range(5)]
    rows = [(i, prose(i, 120), "en", "s", 1) for i in range(100)]
    rows += [(1000, junk[0], "xx", "s", 1), (1001, junk[1], None, None, 1), (1002, junk[2], "en", "rare", 1)]
    rows += [(1003, junk[3], "yy", "s", 1), (1004, junk[4], "yy", "s", 1), (1005, prose(900, 120), "zz", None, 1)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert not any(got[i].kept or got[i].base_failed for i in range(1000, 1005))
    assert got[1005].kept


def test_quality_edge_cases(docs, nothing):
    got = quality.judge(docs)
    assert got.count() == len(rows_of_documents())
    assert quality.judge(nothing).count() == 0
    only_short = docs.filter("doc_id IN (1, 2, 10)")
    assert [r.kept for r in quality.judge(only_short).collect()] == [False] * 3


def test_estimate_equals_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, quality.P)) @ rng.normal(size=(quality.P, quality.P)) + 3
    rows = spark.createDataFrame([("g", 0, *map(float, r)) for r in x], ["grp", "start", *quality.STATISTICS])
    found = quality._estimates(quality._moments(rows)).first()
    assert np.allclose(found.center, x.mean(0))
    assert np.allclose(np.linalg.inv(np.reshape(found.inverse, (quality.P, quality.P))), np.cov(x.T, bias=True), rtol=1e-4)


def plain_dice(a: str, b: str) -> float:
    def bag(t):
        w = re.sub(r"[^a-z0-9]+", " ", t.lower()).split()
        return Counter(zip(w, w[1:]))

    x, y = bag(a), bag(b)
    return 2 * sum((x & y).values()) / max(sum(x.values()) + sum(y.values()), 1)


def test_licenses(spark, nothing):
    full = licenses.TEMPLATES["MIT"]
    rows = [
        (1, prose(1, 40) + "\nReleased under the MIT license.\n" + prose(2, 10)),
        (2, prose(1, 40) + "\n\n" + full.replace("merge,", "") + "\n\n" + prose(3, 900)),
        (3, full),
        (4, None),
        (5, ""),
        (6, prose(3, 500)),
        (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0!"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(None))
    got = {(r.doc_id, r.license): (r.dice, r.units) for r in licenses.scan(docs).collect()}
    expected = {}
    for key, text in rows:
        if text is None:
            continue
        units = text.split("\n") + re.split(r"\n[ \t\r]*\n", text) + [text]
        for name, template in licenses.TEMPLATES.items():
            hits = [d for d in (plain_dice(u, template) for u in units) if d >= 0.8]
            if hits:
                expected[key, name] = (round(max(hits), 6), len(hits))
    assert got == expected and {k for k, _ in got} == {1, 2, 3, 7}
    assert licenses.scan(nothing).count() == 0
    assert licenses.scan(docs, templates={}).count() == 0


def wrapped(text: str, width: int = 12) -> str:
    words = text.split()
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_passages_inside_long_documents(spark, nothing):
    mit, apache, gpl = (licenses.TEMPLATES[k] for k in ("MIT", "Apache-2.0-header", "GPL-3.0-header"))
    mit = mit.replace("The above", "\n\nThe above").replace('THE SOFTWARE IS PROVIDED "AS', '\n\nTHE SOFTWARE IS PROVIDED "AS', 1)
    apache, gpl = apache.replace("Unless", "\n\nUnless"), gpl.replace("This program is dist", "\n\nThis program is dist")
    around = [(wrapped(prose(i, 900)), wrapped(prose(i + 50, 900))) for i in range(3)]
    rows = [(i, f"{a}\n{t}\n{b}") for i, (t, (a, b)) in enumerate(zip((mit, apache, gpl), around))]
    rows += [(3, "Copyright 2024 Jane Doe. Released under the MIT License."), (4, wrapped(mit) + "\n" + prose(9, 100))]
    rows += [(5, None), (6, ""), (7, prose(3, 900)), (8, "of the " * 3000), (9, f"{mit} {prose(8, 60)} {mit}")]
    rows += [(10 + i, f"{prose(i, 300)} {t} {prose(i + 1, 300)}") for i, t in enumerate(licenses.PASSAGE_TEMPLATES.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license): r for r in licenses.passages(docs).collect()}
    wanted = [(0, "MIT"), (1, "Apache-2.0-header"), (2, "GPL-3.0-header"), (3, "MIT-notice"), (4, "MIT"), (9, "MIT")]
    wanted += [(10 + i, n) for i, n in enumerate(licenses.PASSAGE_TEMPLATES)]
    assert all(got[w].dice == 1.0 for w in wanted)
    assert got[9, "MIT"].passages == 2 and got[0, "MIT"].start == 900
    assert not {k for k, _ in got} & {5, 6, 7, 8}
    units = {(r.doc_id, r.license): r.dice for r in licenses.scan(docs).collect()}
    assert all(got[k].dice >= d for k, d in units.items())
    assert not {(i, n) for i, n in wanted[:6] if i != 9} & set(units)
    assert licenses.passages(nothing).count() == 0


def test_passages_equal_plain_windows():
    r = random.Random(4)
    templates = {"x": "a b c a b d", "y": "b c d e a"}
    for _ in range(150):
        words = [r.choice("abcdefg") for _ in range(r.randint(0, 16))]
        for name, template in templates.items():
            every = [plain_dice(" ".join(words[i:j]), template) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
            got = [f for f in licenses.Matcher(templates, 0.6).find(" ".join(words)) if f[0] == name]
            best = max(every, default=0)
            assert [f[1] for f in got] == ([round(best, 6)] if best >= 0.6 else [])
            for _, dice, start, n, _ in got:
                assert round(plain_dice(" ".join(words[start : start + n]), template), 6) == dice


def test_common_licenses_are_known():
    names = {"BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-header", "LGPL-header", "AGPL-3.0-header", "CC-BY-SA-4.0-notice", "Unlicense"}
    matcher = licenses.Matcher(licenses.PASSAGE_TEMPLATES, 0.8)
    for name in names:
        found = matcher.find(f"{prose(1, 200)}\n{licenses.PASSAGE_TEMPLATES[name]}\n{prose(2, 200)}")
        assert max(found, key=lambda f: f[1])[:2] == (name, 1.0)
