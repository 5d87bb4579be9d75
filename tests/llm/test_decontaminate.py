import hashlib
import random
import re

from stayscope.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, size):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for key, item in items:
        own = WORD.findall((item or "").translate(LOWER))
        n = min(size, len(own))
        for at in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[at : at + n]:
                    hit.update(range(i, i + n))
                    found.add(str(key))
    return len(words), len(hit), sorted(found), hit


def cases():
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("ab cé d x9 Öl".split()) for _ in range(rng.randrange(0, 9)))) for i in range(12)]
    items += [(50, "Ab, cé;  d!"), (51, "Ab, cé;  d!"), (52, None), (53, "...")]
    docs = [(i, rng.choice(["", "🦊 "]) + rng.choice([" ", ", ", "\n"]).join(rng.choice("ab CÉ d x9 Öl cé AB".split()) for _ in range(rng.randrange(40)))) for i in range(60)]
    return docs, items


def test_against_brute_force(texts, odd):
    docs, items = cases()
    docs = odd + docs
    for block_bytes in (8_000_000, 60):
        df = texts(docs)
        got = d.find_passages(df, texts(items, "item_id"), ["doc_id", "text"], window=4, block_bytes=block_bytes).collect()
        assert len(got) == len(docs)
        results = {(r["kept"]["doc_id"], r["kept"]["text"]): r for r in got}
        for key, text in docs:
            r = results[key, text]
            n_words, n_hit, found, hit = brute(text, items, 4)
            assert (r["n_words"], r["n_hit"], r["items"]) == (n_words, n_hit, found)
            low = (text or "").translate(LOWER)
            inside = [w for s in r["spans"] for w in WORD.findall(low[s["start"] : s["end"]])]
            assert inside == [w for i, w in enumerate(WORD.findall(low)) if i in hit]


def test_rows_that_stay(texts):
    docs, items = cases()
    df = texts(docs + docs[:5])
    left = d.drop_contaminated(df, texts(items, "item_id"), window=4)
    assert left.columns == df.columns
    want = [x for x in docs + docs[:5] if brute(x[1], items, 4)[1] == 0]
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == sorted(want)


def test_empty_tables(texts):
    docs, items = cases()
    assert d.find_passages(texts([]), texts(items, "item_id"), ["doc_id"]).count() == 0
    none = d.find_passages(texts(docs), texts([], "item_id"), ["doc_id"]).collect()
    assert len(none) == len(docs) and not any(r["n_hit"] for r in none)
