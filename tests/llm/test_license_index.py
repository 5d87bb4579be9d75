import re

from stayscope.llm import license_index as l

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

MORE = [
    (20, "x. Released under the MIT License. MIT license"),
    (21, "Licensed under the Apache License, Version 2.0."),
    (22, "the mit of the license; apache\nLICENSE"),
    (23, "This work is licensed under the GNU General Public License, version 3."),
    (24, "Permission is hereby granted, free of charge, to any person obtaining a copy of this program"),
    (25, "Redistribution and use in source and binary shapes, with or without modification, are permitted"),
]


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    starts, labels = [], set()
    for phrase, label in l.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return words, sorted(starts), labels


def test_against_brute_force(texts, odd):
    rows = odd + MORE
    df = texts(rows)
    frequencies = l.document_frequencies(df)
    assert frequencies[""] == len(rows) and frequencies["license"] == 4
    got = l.scan_licenses(df, frequencies).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in got:
        by_key.setdefault(r["doc_id"], []).append(r)
    for key, text in rows:
        words, starts, labels = brute(text)
        r = next(r for r in by_key[key] if r["n_words"] == len(words))
        assert (r["n_base"], r["first_word"], r["last_word"]) == (
            len(starts),
            starts[0] if starts else None,
            starts[-1] if starts else None,
        )
        assert r["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(r["labels"].split(",")) if labels else True
        assert 0 <= r["score"] <= 1
        for f in r["found"]:
            template = [t for t in l.TEMPLATES if t.label == f["label"]]
            assert any(
                sum(0 <= f["start"] + j < len(words) and words[f["start"] + j] == w for j, w in enumerate(t.notice.split()))
                / len(t.notice.split())
                == f["score"]
                for t in template
            )
    found = {k: v[0]["labels"] for k, v in by_key.items()}
    assert found[20] == "mit" and found[21] == "apache,apache-2.0" and found[23] == "gpl,gpl-3.0"
    assert found[24] == "mit" and found[25] == "" and found[22] == "apache"
    assert by_key[20][0]["score"] == 1.0 and by_key[23][0]["score"] == 1.0


def laid_out(words):
    """(label, start, score) of every template at every place that reaches the score and has the phrases."""
    found = set()
    for t in l.TEMPLATES:
        notice = t.notice.split()
        for start in range(1 - len(notice), len(words)):
            same = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(notice))
            span = " ".join(words[max(start, 0) : max(start, 0) + len(notice)])
            if same / len(notice) >= 0.8 and all(f" {p} " in f" {span} " for p in t.phrases):
                found.add((t.label, start, same / len(notice)))
    return found


def test_every_notice_is_found_whatever_else_the_text_holds(texts):
    notices = [t.notice for t in l.TEMPLATES]
    vocabulary = sorted({w for n in notices for w in n.split()})
    noise = " ".join(vocabulary[::-1])
    rows = [(0, ". ".join(notices)), (1, f"{noise}. {'. '.join(notices[::-1])}. {noise}")]
    rows += [(10 + i, f"{noise}. {n}") for i, n in enumerate(notices)]
    # The rarest words of a notice replaced, as many as its score allows.
    rows += [(30, "permission is hereby granted free of charge to any human obtaining one copy of this thing")]
    rows += [(31, f"{noise}. {rows[-1][1]}")]
    df = texts(rows)
    got = {r["doc_id"]: r for r in l.scan_licenses(df, l.document_frequencies(df)).collect()}
    for key, text in rows:
        want = laid_out(WORD.findall(text.translate(LOWER)))
        assert {(f["label"], f["start"], f["score"]) for f in got[key]["found"]} == want, key
    labels = {t.label for t in l.TEMPLATES}
    assert labels <= set(got[0]["labels"].split(",")) and labels <= set(got[1]["labels"].split(","))
    assert got[30]["labels"] == "mit" and got[30]["score"] == 13 / 16


def test_empty_table(texts):
    df = texts([])
    assert l.scan_licenses(df, l.document_frequencies(df)).count() == 0
