"""Tables with awkward rows, and simple versions of what the operators do."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, _language string, _matches int, _masked string, _id long, _key string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(40_000))


def words(text):
    return re.findall(r"[^\t\n\f\r ]+", (text or "").lower())


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with the helpers' names."""
    rows = [
        (1, "the cat sat on the mat and then it slept", "en", "a", 40),
        (1, "the cat sat on the mat and then it slept", "en", "a", 40),
        (2, "the cat sat on the mat and then it slept", "en", "b", 40),
        (3, None, "en", "a", None),
        (4, "", "en", "a", 0),
        (5, " \t\n\n ", None, None, 5),
        (6, LONG, "en", "a", len(LONG)),
        (7, "x" * 100_000, "de", "a", 100_000),
        (None, "a text without a number of its own", None, None, 34),
        (None, None, None, None, None),
        (8, "12345 67890 !!! ???", "de", "b", 19),
        (9, "zwei drei\nvier fünf sechs sieben", "de", "b", 32),
    ]
    return spark.createDataFrame([(*r, "c", "l", 1, "m", 2, "k") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n=3):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def jaccard_pairs(docs, threshold=0.5, n=3):
    """{(a, b): similarity} in the form of the join's result."""
    sets = {}
    for doc_id, text in docs:
        if doc_id is not None and shingles(text, n):
            sets.setdefault(shingles(text, n), set()).add(doc_id)
    reps = {s: min(ids) for s, ids in sets.items()}
    out = {(reps[s], i): 1.0 for s, ids in sets.items() for i in ids if i != reps[s]}
    items = sorted(reps.items(), key=lambda x: x[1])
    for i, (a, ra) in enumerate(items):
        for b, rb in items[i + 1 :]:
            k = len(a & b)
            if ra != rb and k >= threshold * (len(a) + len(b) - k):
                out[ra, rb] = round(k / (len(a) + len(b) - k), 9)
    return out


def longest_run(doc, item):
    """(words, place in doc, place in item) of the longest common run, the earliest of equals."""
    best = (0, 0, 0)
    for i in range(len(doc)):
        for j in range(len(item)):
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    return best


def contaminated(docs, bench, least=13, least_item=5):
    """{(doc_id, item_id): (words, doc_word, item_word)}"""
    out = {}
    for doc_id, text in docs:
        for item_id, item in bench:
            own = words(item)
            if len(own) >= least_item:
                n, i, j = longest_run(words(text), own)
                if n >= min(least, len(own)):
                    out[doc_id, item_id] = (n, i, j)
    return out
