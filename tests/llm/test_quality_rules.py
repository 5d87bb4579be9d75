import re

import numpy as np

from stayscope.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(line in lines[:i] for i, line in enumerate(lines)),
        len(repeated),
    )


MORE = [
    (30, "a b c a b c a b c d"),
    (31, "x x x x x"),
    (32, "a b c d a b c\na b c d\n\na b c d\n a b c d"),
    (33, "one#two*three $$ é%&|<> " * 20),
    (34, "no repeats at all here"),
]


def test_counts(texts, odd):
    rows = [r for r in odd if r[0] != 6] + MORE
    got = q.text_counts(texts(rows), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(r[n] for n in names) == brute(r["kept"]["text"])
    (long,) = q.text_counts(texts([r for r in odd if r[0] == 6]), ["doc_id"]).collect()
    assert (long["n_words"], long["n_repeat_words"]) == (30_001, 30_000)


def sample(n=3000, seed=4):
    rng = np.random.default_rng(seed)
    values = {name: rng.random(n) for name in q.features()}
    bad = ((values["symbols_per_word"] > 0.7) & (values["upper_share"] < 0.5)) | (values["repeat_share"] > 0.9)
    return values, bad


def test_learner_finds_planted_rules_on_held_out_rows():
    rules = q.learn_rules(*sample())
    values, bad = sample(seed=9)
    caught = np.zeros(len(bad), bool)
    for rule in rules:
        caught |= q._mask(rule, values, len(bad))
    assert (caught & bad).sum() > 0.95 * bad.sum()
    assert (caught & ~bad).sum() < 0.02 * (~bad).sum()
    assert all(1 <= len(rule) <= 4 for rule in rules)


def test_noise_gives_no_rules():
    values, _ = sample()
    assert q.learn_rules(values, np.random.default_rng(0).random(3000) < 0.2) == []
    assert q.learn_rules(values, np.zeros(3000, bool)) == []


def junk_table(texts):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60 + i % 40))) for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{i}y{j}###" for j in range(60 + i % 40))) for i in range(100)]
    return good, bad, texts(good + bad + [(None, None), (5000, "short")])


def test_fit_and_judge(spark, texts):
    good, bad, df = junk_table(texts)
    labels = spark.createDataFrame(
        [*((k, 1) for k, _ in good), *((k, 0) for k, _ in bad), (None, 0), (7777, None), (0, 1)], "doc_id long, quality int"
    )
    rules = q.fit_rules(df, labels)
    assert rules and rules == q.fit_rules(df.repartition(7), labels)
    kept = q.keep_good(df, rules)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, _ in good]
    judged = q.judge(df, rules, ["doc_id"]).collect()
    assert len(judged) == df.count()
    # The Spark condition and the learner's own give the same verdict.
    for r in judged:
        values = {n: np.array([r[o] / max(r[u], 1) if u else r[o]]) for n, (o, u) in q.features().items()}
        first = next((i for i, rule in enumerate(rules, 1) if q._mask(rule, values, 1)[0]), None)
        assert r["rule"] == first
        assert r["passed"] == (not r["base_failed"] and first is None)


def test_without_labels(spark, texts):
    _, _, df = junk_table(texts)
    rules = q.fit_rules(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert rules == [] and q.judge(df, rules, ["doc_id"]).where("rule is null").count() == df.count()
    assert q.judge(texts([]), rules, ["doc_id"]).count() == 0
