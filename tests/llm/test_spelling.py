import random
import zlib

import pytest

from stayscope.llm import spelling as s
from stayscope.llm.queries import runs_with_typos


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return sorted((w, forms[w], root(w), n, len(near[w]), counts.get(forms[w])) for w, n in counts.items())


def vocabulary(spark, rows):
    return spark.createDataFrame([(w, n, "x", 1) for w, n in rows], "word string, n long, form string, n_near int")


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    return sorted(rows, key=lambda r: r[0])


def words(n, letters, lengths, seed):
    rnd = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rnd.choices(letters, k=rnd.choice(lengths)))
        for _ in range(rnd.randint(1, 4)):
            out[w] = rnd.choice([2, 3, 20, 40, 400, 5000, 60000])
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :]]) or w
    return out


@pytest.mark.parametrize("letters, lengths", [("ab", range(1, 9)), ("abcé÷ÿ", range(3, 8)), (s.ALPHABET, range(7, 12))])
def test_against_brute_force(spark, letters, lengths):
    counts = words(400, letters, lengths, len(letters))
    assert got(s.group_variants(vocabulary(spark, counts.items()))) == brute(counts)


def test_small_filters_change_nothing(spark, monkeypatch):
    """Full filters let everything through, small ones come in slices; the exact join decides."""
    counts = words(300, "abcde", range(5, 9), 4)
    assert got(s.group_variants(vocabulary(spark, counts.items()), filter_bytes=100)) == brute(counts)
    monkeypatch.setattr(s, "WORD_BITS", 1)
    assert got(s.group_variants(vocabulary(spark, counts.items()))) == brute(counts)


def test_odd_vocabularies(spark):
    long = "x" * 3000
    rows = [(None, 5), ("lacking", None), ("", 7), ("a", 1), ("repeated", 2), ("repeated", 3), ("repeatd", 60), (long, 2), (long + "y", 40), ("日本語", 2), ("日本", 90)]
    expected = brute({"": 7, "a": 1, "repeated": 5, "repeatd": 60, long: 2, long + "y": 40, "日本語": 2, "日本": 90})
    assert got(s.group_variants(vocabulary(spark, rows))) == expected
    assert got(s.group_variants(vocabulary(spark, []).limit(0))) == []
    with pytest.raises(ValueError):
        s.group_variants(vocabulary(spark, rows), ratio=1)


def test_long_chains_of_forms(spark):
    """Every step has ten times the count of the one before."""
    counts = {"a" * k + "b" * (12 - k): 2 * 10**k for k in range(13)}
    result = got(s.group_variants(vocabulary(spark, counts.items())))
    assert result == brute(counts) and {r[2] for r in result} == {"a" * 12}


def test_words_of_texts(spark, texts, odd):
    import re

    rows = odd + [(i, "Ÿber Überraschung überraschung ÜBERRASCHUNG kommentare Kommentare×÷ſ") for i in range(200)]
    counts = {}
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    expected = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    found = s.count_words(runs_with_typos(texts(rows)))
    assert {r["word"]: r["n"] for r in found.collect()} == expected
    assert len(expected) > 5
